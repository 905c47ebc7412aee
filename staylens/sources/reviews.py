"""Reading and writing listing-review tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.scalars import to_number
from staylens.operators.checks import require_columns
from staylens.sources.records import read_records

# Texts that mean "missing" in a CSV file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Column names of a listing-review file and the type each is read as.
REVIEW_COLUMNS: dict[str, str] = {
    "index": "long",
    "Review ID": "long",
    "Reviewer ID": "long",
    "Reviewer Name": "string",
    "Review Date": "date",
    "Comments": "string",
    "Listing ID": "long",
    "Listing URL": "string",
    "Listing Name": "string",
    "Host ID": "long",
    "Host URL": "string",
    "Host Name": "string",
    "Host Since": "date",
    "Host Response Time": "string",
    "Host Response Rate": "string",
    "Is Superhost": "string",
    "Neighborhood Group": "string",
    "neighbourhood": "string",
    "City": "string",
    "Postal Code": "string",
    "Country": "string",
    "Country Code": "string",
    "Latitude": "double",
    "Longitude": "double",
    "Is Exact Location": "string",
    "Property Type": "string",
    "Room Type": "string",
    "Square Feet": "double",
    "Price": "string",
    "Reviews": "double",
    "First Review": "date",
    "Last Review": "date",
    "Overall Rating": "double",
    "Accuracy Rating": "double",
    "Cleanliness Rating": "double",
    "Checkin Rating": "double",
    "Communication Rating": "double",
    "Location Rating": "double",
    "Value Rating": "double",
    "Instant Bookable": "string",
    "Business Travel Ready": "string",
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column, so that both mean "missing"."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value).alias(field.name)
        columns.append(value)
    return df.select(*columns)


_RECORD = "_malformed_record"
_QUOTES = {"quote": '"', "escape": '"'}
READERS = ("auto", "split", "whole")


def _csv_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RECORD]])


def _read_whole(spark: SparkSession, path: str, names: Sequence[str], multiline: bool) -> DataFrame:
    """Spark's own reader: with ``multiline`` one task per file."""
    # without pruning, since a pruned read does not count the cells of a record
    reader = spark.read.schema(_csv_schema(names)).option("columnNameOfCorruptRecord", _RECORD).option("columnPruning", False)
    return reader.csv(path, header=True, multiLine=multiline, enforceSchema=False, **_QUOTES)


def _read_split(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Records found by many tasks per file, then parsed each by itself."""
    records = read_records(spark, path)
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _RECORD])
    # a line break inside a cell is one line feed, however the file writes it
    record = F.regexp_replace("record", "\r\n", "\n")
    options = {**_QUOTES, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD, "columnPruning": "false", "lineSep": "\n", "maxCharsPerColumn": "-1"}
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    header = F.from_csv("record", cells, options)
    # Spark gives names of its own to columns without one, and numbers to repeated ones
    same = [F.coalesce(header[f"c{i}"], F.lit("")).isin(n, "", n.removesuffix(str(i))) for i, n in enumerate(names)]
    differs = F.raise_error(F.concat(F.lit("the header of a file differs from the first one: "), F.col("record"))).cast("boolean")
    rows = records.where(F.when(~F.col("is_header"), True).when(reduce(and_, same), False).otherwise(differs))
    return rows.select(F.from_csv(record, ddl, options).alias("row")).select("row.*")


def _read_csv(spark: SparkSession, path: str, multiline: bool, reader: str) -> tuple[DataFrame, list[str]]:
    """All cells as text, with the whole record where its number of cells is not the header's."""
    if reader not in READERS:
        raise ValueError(f"reader is one of {READERS}")
    names = spark.read.csv(path, header=True, multiLine=multiline, **_QUOTES).columns
    if multiline and reader == "auto":
        largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
        reader = "split" if largest > _split_bytes(spark) else "whole"
    if multiline and reader == "split":
        return _read_split(spark, path, names), names
    return _read_whole(spark, path, names, multiline), names


def _split_bytes(spark: SparkSession) -> int:
    """Bytes of a file that one task reads at most."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def cell_count(record: Column) -> Column:
    """The number of cells of a CSV record, filled or not.

    The record is cut at its quotes. A state says what the text between two quotes is: 0 the
    beginning of a cell, 1 the rest of an unquoted one, 2 quoted, 3 what follows a closing quote.
    """
    start = F.struct(F.lit(0).alias("state"), F.lit(1).alias("cells"))

    def step(acc: Column, part: Column) -> Column:
        state, empty, comma = acc["state"], F.length(part) == 0, part.endswith(",")
        after = (
            F.when(state == 2, 3).when(state == 3, F.when(empty | comma, 2).otherwise(1))
            .when(state == 0, F.when(empty | comma, 2).otherwise(1)).otherwise(F.when(comma, 2).otherwise(1))
        )
        commas = F.length(part) - F.length(F.replace(part, F.lit(","), F.lit("")))
        return F.struct(after.alias("state"), (acc["cells"] + F.when(state == 2, 0).otherwise(commas)).alias("cells"))

    return F.aggregate(F.split(record, '"'), start, step, lambda acc: acc["cells"])


def _surplus(names: Sequence[str]) -> Column:
    """Whether a row's record has more cells than there are names; false for a row without a record."""
    return F.coalesce(cell_count(F.col(_RECORD)) > len(names), F.lit(False))


def _reads(name: str) -> Column:
    """Always true, but reads a column: Spark refuses to read the malformed record alone."""
    return F.length(F.coalesce(F.col(f"`{name}`"), F.lit(""))) >= 0


def malformed_rows(spark: SparkSession, path: str, multiline: bool = True, reader: str = "auto") -> DataFrame:
    """(kind, record) of CSV rows with another number of cells than the header: ``surplus`` or ``short``."""
    raw, names = _read_csv(spark, path, multiline, reader)
    kind = F.when(_surplus(names), "surplus").otherwise("short")
    return raw.where(F.col(_RECORD).isNotNull() & _reads(names[0])).select(kind.alias("kind"), F.col(_RECORD).alias("record"))


def load_reviews(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] = REVIEW_COLUMNS,
    fmt: str = "csv",
    multiline: bool = True,
    surplus: str = "raise",
    reader: str = "auto",
    counts: Observation | None = None,
) -> DataFrame:
    """Read a table; CSV columns are typed by *name*, in whatever order they come.

    Nothing is inferred, so a type never depends on the data: a value that does not fit
    its type is missing. Columns without a type stay strings. A row with more cells than
    the header, filled or not, fails the read; with ``surplus="quarantine"`` it is left out
    here and given by :func:`malformed_rows`. A row with fewer cells is filled up with missing
    values and listed there too.

    ``multiline`` allows line breaks inside quoted comments. ``reader="split"`` reads such files
    with many tasks each, after a look through them at once; ``"whole"`` with one task per file;
    ``"auto"`` splits when a file is larger than what one task reads. The rows are the same.
    ``counts`` observes the read itself: once an action has run on the result, it has ``rows``
    (all records), ``short`` and ``surplus``, without a second scan.
    """
    if fmt == "parquet":
        table = spark.read.parquet(path)
        if counts is not None:
            none = F.lit(0).cast("long")
            table = table.observe(counts, F.count(F.lit(1)).alias("rows"), F.max(none).alias("short"), F.max(none).alias("surplus"))
        return nan_to_null(table)
    if fmt != "csv":
        raise ValueError(f"unsupported format: {fmt}")
    if surplus not in ("raise", "quarantine"):
        raise ValueError("surplus is 'raise' or 'quarantine'")
    raw, names = _read_csv(spark, path, multiline, reader)
    has_surplus = _surplus(names)
    if counts is not None:
        short = F.count_if(F.col(_RECORD).isNotNull() & ~has_surplus)
        raw = raw.observe(counts, F.count(F.lit(1)).alias("rows"), short.alias("short"), F.count_if(has_surplus).alias("surplus"))
    refused = F.lit(False)
    if surplus == "raise":
        refused = F.raise_error(F.concat(F.lit("more cells than the header has: "), F.col(_RECORD))).cast("boolean")
    raw = raw.where(F.when(has_surplus & _reads(names[0]), refused).otherwise(True))
    columns = []
    for name in names:
        text = F.col(f"`{name}`")
        text = F.when(~text.isin(*MISSING_TOKENS), text)
        kind = types.get(name, "string")
        if kind == "double":
            text = to_number(text)
        elif kind == "long":  # ids written as 12 or as 12.0
            text = F.coalesce(text.try_cast("long"), to_number(text).try_cast("long"))
        elif kind != "string":
            text = text.try_cast(kind)
        columns.append(text.alias(name))
    return nan_to_null(raw.select(*columns))


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write the table; ``errorifexists`` never replaces data."""
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Save as a catalog table whose rows lie in ``buckets`` files by ``key``, sorted by it, and return it.

    Statistics per key, and joins on the key of tables with as many buckets, then need no
    exchange, however often the table is read: the shuffle is paid once, here. ``path`` is the
    folder of the data (the warehouse without it). Read it again with ``spark.table(name)``.
    """
    require_columns(df, [key])
    writer = df.repartition(buckets, F.col(f"`{key}`")).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def preview(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows; with ``order_by`` always the same ones."""
    if order_by is None:
        return df.limit(n)
    require_columns(df, [order_by])
    return df.orderBy(F.col(f"`{order_by}`")).limit(n)
