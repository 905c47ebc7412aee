"""Profiling: what is in a table, what is missing, what repeats.

A profile of k columns is one aggregate over one scan, never a job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.scalars import grouping_key, present
from staylens.operators.checks import require_columns
from staylens.operators.quantiles import ValueTable, group_names, long_values, named_groups, value_table, with_quantiles

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("q25", "median", "q75")
_FIGURES = ("count", "mean", "std", "min", *QUARTILE_NAMES, "max")


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def category_columns(df: DataFrame) -> list[str]:
    kinds = (T.StringType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _per_column(df: DataFrame, value, name: str) -> DataFrame:
    """(column, <name>, dtype), one row per column, from one aggregate."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    wide = df.agg(*[value(c).alias(c) for c in df.columns])
    return wide.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", name).withColumn(
        "dtype", types[F.col("column")]
    )


def column_info(df: DataFrame) -> DataFrame:
    """(column, non_null, dtype)."""
    return _per_column(df, lambda c: F.count_if(present(c, is_float(df, c))), "non_null")


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing, dtype), most missing first."""
    found = _per_column(df, lambda c: F.count_if(~present(c, is_float(df, c))), "missing")
    return found.orderBy(F.desc("missing"), "column")


def missing_percent(df: DataFrame) -> DataFrame:
    """(column, missing_percent) for the columns that miss anything."""
    def share(c: str) -> Column:
        return F.avg(F.when(present(c, is_float(df, c)), 0.0).otherwise(100.0))

    found = _per_column(df, share, "missing_percent")
    return found.where(F.col("missing_percent") > 0).select("column", "missing_percent")


def _row_key(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    keys = []
    for c in cols:
        kind = df.schema[c].dataType
        keys.append(grouping_key(F.col(f"`{c}`"), isinstance(kind, T.StringType), is_float(df, c)).alias(c))
    return keys


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """(duplicates): rows equal to an earlier row; missing values equal each other."""
    cols = list(subset or df.columns)
    require_columns(df, cols)
    return (
        df.select(*_row_key(df, cols))
        .groupBy(*[F.col(f"`{c}`") for c in cols])
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicates"))
    )


def dedupe(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key combination: the first in the order of ``order_by``, then of all columns.

    Missing values come first, and missing keys equal each other. The choice depends on
    the rows alone, so a retried task makes it again; rows are aggregated before the shuffle.
    """
    require_columns(df, [*keys, *order_by])
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    order = [*order_by, *[c for c in rest if c not in order_by]]
    first = F.min(F.struct(*[F.col(f"`{c}`") for c in order if c in rest])).alias("_first")
    found = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(first)
    return found.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def describe(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    """count, mean, std, min, quartiles and max per column - and per group, with ``by``.

    Groups without a key are left out; missing values are not counted. The values are
    counted when this is called, in one scan that all figures come from; with ``accuracy`` one
    lazy aggregate gives all of them, the quartiles sketched.
    """
    require_columns(df, [*cols, *by])
    if accuracy is None:
        return describe_values(value_table(df, cols, by))
    keys = [*group_names(by), "column"]
    sketch = F.percentile_approx("v", list(QUARTILES), accuracy)
    found = long_values(df, cols, by).groupBy(*keys).agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"), sketch.alias("_q"),
    )
    found = found.select("*", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(QUARTILE_NAMES)])
    return named_groups(found.select(*keys, *_FIGURES), by)


def describe_values(table: ValueTable) -> DataFrame:
    """What :func:`describe` gives, from values that are counted already."""
    spread = with_quantiles(table, QUARTILES).withColumnsRenamed({f"q{i}": name for i, name in enumerate(QUARTILE_NAMES)})
    gap = F.col("v") - F.col("mean")
    found = spread.groupBy(*table.keys, F.col("total").alias("count"), "mean", *QUARTILE_NAMES).agg(
        F.sqrt(F.try_divide(F.sum(F.col("n") * gap * gap), F.when(F.max("total") > 1, F.max("total") - 1))).alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    return named_groups(found.select(*table.keys, *_FIGURES), table.by)


def describe_by(
    df: DataFrame, by: str | Sequence[str], cols: str | Sequence[str], accuracy: int | None = None
) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    cols = [cols] if isinstance(cols, str) else list(cols)
    return describe(df, cols, by, accuracy)


def describe_categorical(df: DataFrame, col: str) -> DataFrame:
    """(column, count, unique, top, freq); equally frequent values give the smallest."""
    require_columns(df, [col])
    value = F.col(f"`{col}`")
    counts = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("top"),
        F.max("n").alias("freq"),
    ).select(F.lit(col).alias("column"), "count", "unique", "top", "freq")


def category_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) of every string and boolean column, or of ``cols``."""
    cols = category_columns(df) if cols is None else list(cols)
    require_columns(df, cols)
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in cols]
    long = df.select(*texts).unpivot([], [F.col(f"`{c}`") for c in cols], "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
