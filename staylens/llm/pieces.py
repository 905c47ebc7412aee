"""SentencePiece encoding and decoding with a table of distinct chunks.

The pieces of the model may start with white-space markers but never hold one after
another character, so no merge crosses the start of a marked word. A text is therefore
cut into chunks (a run of markers and what follows up to the next), each distinct chunk
is segmented once, and the ids are joined back by position. The table is local to a
task and filled batch by batch: a shuffled table of all chunks would move every word of
the corpus twice to save work that the local table saves already.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import bound_batches, text_or_empty

MARK = "▁"
CHUNK = re.compile(r" +[^ ]*")
# Memory bounds of a task's table: longer chunks are segmented each time, and a full
# table is emptied. Neither changes any result.
MAX_CHUNK = 64
MAX_TABLE = 200_000


class Segmenter:
    """A model with its table of distinct chunks."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for p in map(self.model.id_to_piece, range(len(self.model))) if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing:
            raise ValueError(f"pieces cross white-space markers: {crossing[:3]}")
        self.end = self.model.eos_id()
        self.single = [self.model.piece_to_id(MARK)]
        self.decimals = [*map(str, range(len(self.model)))]
        self.table: dict[str, list[int]] = {}

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text; the model puts one marker before a text that is not empty."""
        return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def segment(self, chunks: set[str]) -> dict[str, list[int]]:
        """Ids for every chunk given: those that the table lacks are segmented in one call."""
        table = self.table
        if len(table) > MAX_TABLE:
            table.clear()
        new = [*chunks.difference(table)]
        # the model adds the first marker of a chunk by itself
        found = dict(zip(new, self.model.encode([c[1:] for c in new], num_threads=1))) if new else {}
        if " " in found:
            found[" "] = self.single
        long = {c: i for c, i in found.items() if len(c) > MAX_CHUNK}
        table.update(found)
        for chunk in long:
            del table[chunk]
        return {**table, **long} if long else table

    def encode(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """For each text its ids with the end id."""
        cut = [self.chunks(text) for text in texts]
        ids_of = self.segment(set().union(*cut)).__getitem__
        for chunks in cut:
            ids = [*chain.from_iterable(map(ids_of, chunks))]
            ids.append(self.end)
            yield ids

    def render(self, ids: Sequence[int]) -> str:
        """The ids as decimals joined by one space."""
        return " ".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=4)
def segmenter(model: str) -> Segmenter:
    return Segmenter(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def encode_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str | None = None,
    carry: Sequence[str] = (),
    ids: bool = True,
    digests: bool = False,
) -> DataFrame:
    """One row per input row: id, carried columns, ``n_tokens``, ``ids`` and ``decoded``.

    ``ids`` ends with the end id; ``decoded`` is what the model's ``decode`` gives for
    them. A missing text is an empty one and has the end id alone. With ``ids=False``
    the two wide columns are left out; with ``digests=True`` ``ids_sha256`` (of the
    decimal ids joined by one space) and ``decoded_sha256`` are added. Rows are
    independent: repeated rows and ids give repeated results, extra columns are not read.
    ``model`` is the path of the model file, the same on every executor.
    """
    bound_batches(docs.sparkSession)
    path = model or default_model()
    kept = [f"c{i}" for i in range(len(carry))]
    source = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        *[F.col(f"`{c}`").alias(a) for c, a in zip(carry, kept)],
        text_or_empty(text_col).alias("text"),
    )
    fields = [f for f in source.schema.fields if f.name != "text"]
    fields.append(T.StructField("n_tokens", T.LongType()))
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = segmenter(path)
        gc.disable()  # millions of small lists, no cycles
        for batch in batches:
            counts, lists, texts, sums, text_sums = [], [], [], [], []
            for found in work.encode(batch.column(batch.num_columns - 1).to_pylist()):
                decoded = work.decode(found)
                counts.append(len(found))
                if ids:
                    lists.append(pa.array(found, pa.int32()))
                    texts.append(decoded)
                if digests:
                    sums.append(_sha(work.render(found)))
                    text_sums.append(_sha(decoded))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(counts, pa.int64())]
            if ids:
                offsets = pa.array([0, *_running(counts)], pa.int32())
                values = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
                columns += [pa.ListArray.from_arrays(offsets, values), pa.array(texts, pa.string())]
            if digests:
                columns += [pa.array(sums, pa.string()), pa.array(text_sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    found = source.mapInArrow(encode, T.StructType(fields))
    return found.withColumnsRenamed({"id": id_col, **dict(zip(kept, carry))})


def _running(counts: Sequence[int]) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total
