"""Features: encodings, scaling, splits, class weights and folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.scalars import column, hash_number
from staylens.operators.checks import require_columns
from staylens.operators.profile import numeric_columns
from staylens.operators.stats import number
from staylens.runtime import SizedTable, join_sized, materialize, materialize_sized

# A class is dealt into folds in so many piles, whatever the size of the table: a class
# of a trillion rows is still shared by four thousand tasks.
FOLD_SALTS = 4096


@dataclass(frozen=True)
class OneHot:
    """Codes of the levels of some columns: 0..k-1 in alphabetical order.

    Slot k of a vector means missing and slot k + 1 a level that was not there when the
    codes were made. The levels stay in a table; the driver knows only how many there are.
    """

    codes: dict[str, SizedTable]

    def slots(self, col: str) -> int:
        return self.codes[col].rows + 2

    def transform(self, df: DataFrame, spread: Sequence[str] | None = None) -> DataFrame:
        """Add ``<col>_code`` and the sparse vector ``<col>_vec`` to each row itself."""
        spread = list(spread or df.columns)
        for col, table in self.codes.items():
            code = F.when(column(col).isNull(), table.rows).otherwise(F.coalesce(column(f"{col}_code"), F.lit(table.rows + 1)))
            df = join_sized(df, table, [col], "left", spread).withColumn(f"{col}_code", code.cast("double"))
        names = list(self.codes)
        last = df.sparkSession.createDataFrame(
            [tuple(float(self.slots(c) - 1) for c in names)], ", ".join(f"`{c}_code` double" for c in names)
        )
        encoder = OneHotEncoder(
            inputCols=[f"{c}_code" for c in names], outputCols=[f"{c}_vec" for c in names], dropLast=False
        )
        return encoder.fit(last).transform(df)  # the last slot gives the vector its size

    def levels(self, col: str) -> DataFrame:
        """(slot, level) of a column; the two last slots have no level."""
        spark = self.codes[col].df.sparkSession
        rows = self.codes[col].df.select(column(f"{col}_code").cast("int").alias("slot"), column(col).cast("string").alias("level"))
        extra = spark.createDataFrame([(self.slots(col) - 2, None), (self.slots(col) - 1, None)], "slot int, level string")
        return rows.unionByName(extra)


def one_hot_codes(df: DataFrame, cols: Sequence[str]) -> OneHot:
    """Codes from the levels that ``df`` has; any number of levels."""
    require_columns(df, cols)
    return OneHot({c: materialize_sized(label_codes(df, c).withColumnRenamed("code", f"{c}_code")) for c in cols})


def one_hot(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, OneHot]:
    """Adds ``<col>_code`` and ``<col>_vec`` to each row itself; returns the codes too."""
    encoder = one_hot_codes(df, cols)
    return encoder.transform(df), encoder


def one_hot_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, slot, level, n): how often each slot of the encoding is 1; the last slot is missing."""
    encoded, encoder = one_hot(df.select(*[column(c) for c in cols]), cols)
    parts = None
    for c in cols:
        counts = encoded.groupBy(column(f"{c}_code").cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        part = (
            encoder.levels(c).where(F.col("slot") < encoder.slots(c) - 1)  # nothing is new to its own codes
            .join(counts, "slot", "left")
            .select(F.lit(c).alias("column"), "slot", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(col, code): alphabetical codes 0..k-1 of the distinct values.

    The distinct values are range-partitioned and numbered per partition; adding the
    sizes of the partitions before gives the rank, so no task sees all of them. The
    numbered partitions are stored first, since both steps must see the same ones.
    """
    require_columns(df, [col])
    spark = df.sparkSession
    distinct = df.where(column(col).isNotNull()).select(column(col)).distinct()
    numbered = materialize(
        distinct.repartitionByRange(column(col))
        .sortWithinPartitions(column(col))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.cast("int").alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, starts = 0, []
    for row in sorted(sizes, key=lambda r: r["_part"]):  # one row per partition
        starts.append((row["_part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    return (
        numbered.withColumn("_part", part.cast("int"))
        .join(F.broadcast(offsets), "_part")
        .select(column(col), (F.col("_start") + place).alias("code"))
    )


def label_encode(df: DataFrame, col: str, out: str | None = None, spread: Sequence[str] | None = None) -> DataFrame:
    """Adds ``<col>_encoded``; a missing value has no code.

    ``spread`` names columns that vary within one value (a row key); it is used only
    when the codes are too many to broadcast.
    """
    codes = materialize_sized(label_codes(df, col).withColumnRenamed("code", out or f"{col}_encoded"))
    return join_sized(df, codes, [col], "left", list(spread or df.columns))


def standardize(
    df: DataFrame, cols: Sequence[str] | None = None, fit_on: DataFrame | None = None
) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0.

    All numeric columns when ``cols`` is not given. ``fit_on`` is the table the means
    and deviations come from (the training rows); by default ``df`` itself.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    source = df if fit_on is None else fit_on
    require_columns(df, cols)
    require_columns(source, cols)
    stats = source.agg(
        F.struct(
            *[F.avg(number(source, c)).alias(f"mean_{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(number(source, c)).alias(f"sd_{i}") for i, c in enumerate(cols)],
        ).alias("s")
    ).scalar()
    scaled = {}
    for i, c in enumerate(cols):
        mean, sd, x = F.col(f"_stats.mean_{i}"), F.col(f"_stats.sd_{i}"), number(df, c)
        scaled[c] = F.when((sd == 0) & x.isNotNull(), 0.0).otherwise(F.try_divide(x - mean, sd))
    return df.withColumn("_stats", stats).withColumns(scaled).drop("_stats")


def hash_split(
    df: DataFrame, key: str, test: float = 0.2, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Adds train/test by a hash of the key: no shuffle, the same rows every time.

    The whole 32-bit draw is compared, so any share is met to within chance.
    """
    require_columns(df, [key])
    bound = F.lit(round(float(test) * 2**32))
    return df.withColumn(out, F.when(hash_number(key, seed) < bound, "test").otherwise("train"))


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    marked = hash_split(df, key, test, seed, "_split")
    parts = (marked.where(F.col("_split") == name).drop("_split") for name in ("train", "test"))
    return tuple(parts)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    require_columns(df, [label])
    counts = df.where(column(label).isNotNull()).groupBy(column(label).alias(label)).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("s")).scalar()
    return counts.withColumn("weight", whole["rows"] / (whole["classes"] * F.col("n")))


def with_class_weights(df: DataFrame, label: str, key: str, out: str = "weight") -> DataFrame:
    """Adds the balanced weight of each row's class."""
    table = materialize_sized(class_weights(df, label).select(column(label), F.col("weight").alias(out)))
    return join_sized(df, table, [label], "left", [key])


def oversample(
    df: DataFrame, label: str, key: str, ratio: float = 1.0, seed: int = 42, out: str = "copy"
) -> DataFrame:
    """Rows repeated until every class has about ``ratio`` times the rows of the largest class.

    A class whose share of that is s has each row floor(1 / s) times, and once more where a hash of
    its key falls below the fraction: the same rows every time, also in a task that is
    retried. ``out`` numbers the copies from 0. No class loses rows; rows without a label stay
    single.
    """
    require_columns(df, [label, key])
    counts = df.where(column(label).isNotNull()).groupBy(column(label).alias(label)).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n").alias("m")).scalar()
    times = F.greatest(F.lit(float(ratio)) * largest / F.col("_n"), F.lit(1.0))
    table = materialize_sized(counts.select(column(label), times.alias("_times")))
    drawn = join_sized(df, table, [label], "left", [key])
    more = hash_number(key, seed) < F.round((F.col("_times") - F.floor("_times")) * 2**32)
    copies = F.coalesce(F.floor("_times").cast("int") + more.cast("int"), F.lit(1))
    return drawn.withColumn(out, F.explode(F.sequence(F.lit(0), copies - 1))).select(*[column(c) for c in df.columns], out)


def stratified_folds(
    df: DataFrame,
    key: str,
    label: str,
    folds: int = 5,
    seed: int = 42,
    salts: int = FOLD_SALTS,
    out: str = "fold",
) -> DataFrame:
    """Adds a fold 0..folds-1, with the rows of each class dealt out evenly.

    A class is dealt in ``salts`` independent piles, so that a class with a third of
    all rows is shared by that many tasks. Their number is fixed: a row's pile never
    depends on the size of the table. Fold sizes per class differ by at most that number.
    """
    require_columns(df, [key, label])
    dealt = df.withColumn("_draw", hash_number(key, seed)).withColumn("_pile", F.pmod("_draw", F.lit(salts)))
    order = Window.partitionBy(column(label), F.col("_pile")).orderBy("_draw", column(key))
    place = F.row_number().over(order) + F.col("_pile")
    return dealt.withColumn(out, F.pmod(place, F.lit(folds)).cast("int")).drop("_draw", "_pile")
