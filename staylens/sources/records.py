"""CSV records with quoted line breaks from files that many tasks read at once.

Spark reads a CSV file with line breaks inside quotes in one task, since the byte where a
task starts may lie inside a quoted cell. Here the files are read as lines, in byte ranges,
by Spark's own line reader (so from every store Spark can read):

1. Each range gives the state at its end, inside a quoted cell or not, for both states it may
   begin in. These maps are composed in the order of the ranges, which gives the true state at
   the start of each. One small row per range leaves the tasks.
2. Lines of a record that crosses the edge of a range are few; they are joined to records
   of their own.
3. All other lines make records within their range, in one lazy pass without a shuffle.

A quote opens a cell only at the cell's beginning and is doubled inside, so stray quotes in
unquoted cells mean nothing, as for Spark's reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.runtime import materialize, measure

# Whole cells with their commas, then a quoted cell that the end of the line does not close.
_OPEN = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]|"")*+\Z')


def leaves_open(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell, given whether it begins inside one."""
    if '"' not in line:
        return inside
    return _OPEN.match('"' + line if inside else line) is not None


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line, value): the lines with the range they start in and their order there."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"), "value",
    )


class _Range:
    """One start state of a byte range, followed through its lines."""

    def __init__(self, inside: bool) -> None:
        self.inside = inside
        self.closed: int | None = None  # the line that ends the record the range begins in
        self.opened: int | None = None  # the line that begins the record the range ends in

    def step(self, line: int, value: str) -> None:
        after = leaves_open(value, self.inside)
        if after and not self.inside:
            self.opened = line
        elif self.inside and not after:
            if self.opened is None and self.closed is None:
                self.closed = line
            self.opened = None
        self.inside = after


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, at, first line that is not blank, then for each start state: ends inside, closing line, opening line)."""
    schema = "file string, at long, first long, out_open boolean, out_opened long, in_open boolean, in_closed long, in_opened long"
    names = ["file", "at", "first", "out_open", "out_opened", "in_open", "in_closed", "in_opened"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = first = None
        states = (_Range(False), _Range(True))

        def row() -> list:
            out, into = states
            return [*place, first, out.inside, out.opened, into.inside, into.closed, into.opened]

        for batch in batches:
            done = []
            starts = pc.run_end_encode(batch.column("at")).run_ends.to_pylist()
            files = pc.run_end_encode(batch.column("file")).run_ends.to_pylist()
            low = 0
            for high in sorted({*starts, *files}):
                part = batch.slice(low, high - low)
                here = (part.column("file")[0].as_py(), part.column("at")[0].as_py())
                if here != place:
                    if place is not None:
                        done.append(row())
                    place, first, states = here, None, (_Range(False), _Range(True))
                if first is None:
                    filled = part.filter(pc.invert(pc.is_in(part.column("value"), pa.array(["", "\r"]))))
                    first = filled.column("line")[0].as_py() if filled.num_rows else None
                quoted = part.filter(pc.match_substring(part.column("value"), '"'))
                for line, value in zip(quoted.column("line").to_pylist(), quoted.column("value").to_pylist()):
                    for state in states:
                        state.step(line, value)
                low = high
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], _schema)
        if place is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row()))], _schema)

    kinds = {"file": pa.string(), "out_open": pa.bool_(), "in_open": pa.bool_()}
    _schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
    return lines.mapInArrow(work, schema)


def _with_states(ranges: DataFrame) -> DataFrame:
    """(file, at, inside, closed, opened, wholly, header): each range with its true start state.

    ``closed`` and ``opened`` are the lines that end the record the range begins in and begin the
    one it ends in; ``wholly`` says that the range lies inside one record, ``header`` is the first
    line of the file that is not blank.
    """
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # the state after a range is fixed, or the one before it, or its opposite: the last fixed one counts,
    # turned over as often as ranges have turned it over since
    fixed = F.col("out_open") == F.col("in_open")
    turned = F.when(~fixed & F.col("out_open"), 1).otherwise(0)
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = ranges.withColumn("turns", F.sum(turned).over(upto))
    known = known.withColumn("set", F.when(fixed, F.struct(F.col("out_open").cast("int").alias("state"), F.col("turns").alias("turns"))))
    last = F.last("set", ignorenulls=True).over(before)
    so_far = F.coalesce(F.last("turns").over(before), F.lit(0))
    state = F.coalesce(last["state"] + so_far - last["turns"], so_far)
    inside = F.pmod(state, F.lit(2)) == 1
    known = known.select("*", inside.alias("inside"))
    begins = F.min(F.when(F.col("first").isNotNull(), F.struct("at", "first"))).over(Window.partitionBy("file"))
    return known.select(
        "file", "at", "inside", begins["first"].alias("header"),
        F.when(F.col("inside"), F.col("in_closed")).alias("closed"),
        F.when(F.col("inside"), F.col("in_opened")).otherwise(F.col("out_opened")).alias("opened"),
        (F.col("inside") & F.col("in_closed").isNull()).alias("wholly"),
    )


def _head() -> Column:
    """Whether a line belongs to a record that began in an earlier range."""
    return F.col("wholly") | (F.col("inside") & (F.col("line") <= F.col("closed")))


def _tail() -> Column:
    """Whether a line belongs to a record that ends in a later range, or with the file."""
    return F.coalesce(F.col("line") >= F.col("opened"), F.lit(False))


def _edge_records(placed: DataFrame) -> DataFrame:
    """(line, record, is_header): the records that cross an edge, at most one per range."""
    lines = placed.where(_head() | _tail()).select("file", "at", "line", "value", "header", _head().alias("head"))
    pieces = lines.groupBy("file", "at", "head").agg(
        F.sort_array(F.collect_list(F.struct("line", "value"))).alias("lines"), F.any_value("header").alias("header")
    )
    order = Window.partitionBy("file").orderBy("at", F.desc("head"))
    numbered = pieces.withColumn("number", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("at", (~F.col("head")).alias("tail"), "lines"))).alias("parts")
    joined = numbered.groupBy("file", "number").agg(parts, F.any_value("header").alias("header"))
    text = F.array_join(F.transform(F.flatten(F.col("parts.lines")), lambda x: x["value"]), "\n")
    line = F.col("parts")[0]["lines"][0]["line"]
    return joined.select(line.alias("line"), text.alias("record"), (line == F.col("header")).alias("is_header"))


def _inner_records(lines: DataFrame) -> DataFrame:
    """(line, record, is_header) of (line, value, is_header) whose records begin and end among them, in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["line", "record", "is_header"]
        held: list[str] = []  # the lines of an open record
        start = None
        for batch in batches:
            values = batch.column(1)
            quoted = values.filter(pc.match_substring(values, '"')).to_pylist()
            if not held and not any(leaves_open(v, False) for v in quoted):
                yield pa.RecordBatch.from_arrays(batch.columns, names=names)
                continue
            rows = []
            for line, value, header in zip(*(c.to_pylist() for c in batch.columns)):
                if not held:
                    start = (line, header)
                still_open = leaves_open(value, bool(held))
                held.append(value)
                if not still_open:
                    rows.append((start[0], "\n".join(held), start[1]))
                    held = []
            cells = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, batch.schema)], names=names)

    return lines.mapInArrow(work, "line long, record string, is_header boolean")


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(record, is_header): the CSV records of all files under ``path``, headers included.

    A record ends at a line break outside quoted cells; the break and a carriage return before
    it are left out, as are blank lines and a byte order mark. A quote that nothing closes
    takes the rest of its file into its record. ``is_header`` marks the first record of each
    file. The ranges are looked through when this is called, the records are read lazily;
    between the two, files and ``spark.sql.files.maxPartitionBytes`` must stay as they are,
    which is checked. Up to ``limit`` bytes of ranges are broadcast, more are joined.
    """
    lines = read_lines(spark, path)
    ranges = measure(materialize(_with_states(_ranges(lines))), limit)
    if ranges.fits:
        placed = lines.join(F.broadcast(ranges.df), ["file", "at"], "left")
    else:
        joined = lines.join(ranges.df, ["file", "at"], "left")
        placed = joined.repartition("file", "at").sortWithinPartitions("file", "at", "line")
    edges = materialize(_edge_records(placed))
    stale = F.raise_error(F.lit("the files or their splits have changed since they were looked through")).cast("boolean")
    known = F.when(F.col("inside").isNull(), stale).otherwise(True)
    inner = placed.where(known & ~_head() & ~_tail()).select("line", "value", (F.col("line") == F.col("header")).alias("is_header"))
    found = _inner_records(inner).unionByName(edges)
    text = F.regexp_replace("record", r"^\x{FEFF}|\r$", "")
    return found.select(text.alias("record"), "is_header").where(F.length("record") > 0)
