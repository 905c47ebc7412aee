"""WARC derivatives: metadata and plain-text conversion records from response records.

Each response gives one metadata record (its HTTP status, headers and payload digest as
warc-fields) and one conversion record (its visible text). Both refer to the response,
and the metadata record names the conversion; ids follow from the response's id, so a
retried task writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.common import bound_batches, text_or_empty

HEADERS = "array<struct<name:string,value:string>>"
RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, "
    "content_type string, content_length bigint, block_digest string, source_digest string, block binary"
)
CRLF = b"\r\n"

_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|td|th|section|article|main|nav|header|footer|aside|blockquote|pre|form|br|hr)\b[^>]*>", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z!?][^>]*>")


def plain_text(page: str) -> str:
    """All visible text of a page, one block per line, white space inside a block as one space."""
    text = entities.unescape(_MARKUP.sub("", _BREAK.sub("\0", _GONE.sub("", page))))
    lines = (" ".join(line.split()) for line in text.split("\0"))
    return "\n".join(line for line in lines if line)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + " " + source)}>"


def _line(text: str | None) -> str:
    """A header value: line breaks would end it."""
    return re.sub(r"[\r\n]+", " ", text or "").strip()


def derive_one(record_id: str, uri: str | None, date: str | None, status: int | None, headers, payload: bytes) -> list[dict]:
    """The two records derived from one response."""
    source_digest = digest(payload)
    shared = {"refers_to": record_id, "target_uri": uri, "date": date, "source_digest": source_digest}
    text_id, info_id = derived_id(record_id, "conversion"), derived_id(record_id, "metadata")
    fields = [("sourceStatus", "" if status is None else str(status)), ("sourcePayloadDigest", source_digest), ("sourcePayloadLength", str(len(payload)))]
    fields += [("conversion", text_id)]
    fields += [(f"sourceHeader-{_line(h['name'])}", _line(h["value"])) for h in headers]
    blocks = (
        ("metadata", info_id, "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()),
        ("conversion", text_id, "text/plain; charset=utf-8", plain_text(payload.decode("utf-8", "replace")).encode("utf-8", "replace")),
    )
    return [
        {"record_type": kind, "record_id": own, **shared, "content_type": content, "content_length": len(block), "block_digest": digest(block), "block": block}
        for kind, own, content, block in blocks
    ]


def derive(
    responses: DataFrame,
    record_id: str = "record_id",
    uri: str = "target_uri",
    date: str = "date",
    status: str = "status",
    headers: str = "headers",
    payload: str = "payload",
    carry: str | None = None,
) -> DataFrame:
    """Two rows per response, ``metadata`` and ``conversion``, with WARC fields and ``block``.

    A missing record id counts as an empty one, missing headers as none, a missing
    payload as empty, a missing URI or date stays missing. Nothing is shuffled;
    repeated responses give repeated records; ``carry`` is a column to keep, others are
    not read.
    """
    bound_batches(responses.sparkSession)
    source = responses.select(
        F.col(f"`{carry}`").alias("carry") if carry else F.lit(None).cast("string").alias("carry"),
        text_or_empty(record_id).alias("id"),
        F.col(f"`{uri}`").cast("string").alias("uri"),
        F.col(f"`{date}`").cast("string").alias("date"),
        F.col(f"`{status}`").cast("int").alias("status"),
        F.coalesce(F.col(f"`{headers}`").cast(HEADERS), F.array().cast(HEADERS)).alias("headers"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"),
    )
    kind = source.schema["carry"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                heads = [h for h in r.headers if h is not None]
                made = derive_one(r.id, r.uri, r.date, None if pd.isna(r.status) else int(r.status), heads, bytes(r.payload))
                rows += [{"carry": r.carry, **x} for x in made]
            out = pd.DataFrame(rows, columns=["carry", *[c.split()[0] for c in RECORD.split(", ")]])
            if kind in ("bigint", "int"):
                out["carry"] = pd.array([None if pd.isna(c) else int(c) for c in out["carry"]], "Int64")
            yield out

    found = source.mapInPandas(work, f"carry {kind}, {RECORD}")
    return found.withColumnRenamed("carry", carry) if carry else found.drop("carry")


def serialize(records: DataFrame, record: str = "record") -> DataFrame:
    """Add each record as the bytes of a WARC file; files are these bytes one after the other."""
    def header(name: str, value: Column) -> Column:
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))

    names = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    head = F.concat(F.lit("WARC/1.1\r\n"), *[header(n, F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " ")) for n, c in names], F.lit("\r\n"))
    return records.withColumn(record, F.concat(head.cast("binary"), F.col("block"), F.lit(b"\r\n\r\n")))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record in a WARC file's bytes."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record is cut short")
        yield fields, block


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, plain or compressed, as the columns :func:`derive` takes."""
    bound_batches(spark)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                for fields, block in parse_records(bytes(data)):
                    if fields.get("warc-type") != "response":
                        continue
                    head, _, payload = block.partition(CRLF + CRLF)
                    first, *lines = head.decode("latin-1").split("\r\n")
                    status = re.match(r"HTTP/\S+ (\d{3})", first)
                    headers = [{"name": n.strip(), "value": v.strip()} for n, _, v in (x.partition(":") for x in lines)]
                    yield pd.DataFrame({
                        "record_id": [fields.get("warc-record-id")], "target_uri": [fields.get("warc-target-uri")], "date": [fields.get("warc-date")],
                        "status": pd.array([int(status[1]) if status else None], "Int32"), "headers": [headers], "payload": [payload],
                    })

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(work, f"record_id string, target_uri string, date string, status int, headers {HEADERS}, payload binary")
