"""Exact quantiles (linear interpolation), and all else that values and their counts tell.

The source is read once: :func:`value_table` aggregates it to (group, column, value, n) with
map-side counts and stores that. Quantiles, means, spreads and extremes all read the stored
counts, whose size is known from the write.

* Up to ``WINDOW_ROWS`` counts, running sums per group and column give every order statistic
  in one lazy pass. Ratings, percentages and prices stay far below this whatever the number
  of rows.
* Beyond it a hot group could hold billions of distinct values, which must not meet in one
  task. Then the wanted order statistics are found by narrowing ranges of values, round by
  round: a value maps to a bucket by a non-decreasing function, and each bucket's rows are
  counted together with its smallest and largest value, so a shuffle carries bucket counts
  only. Running counts tell which bucket holds a wanted rank. It is settled when the bucket
  has one distinct value or the rank is at its edge; otherwise the bucket's own range is what
  the next round divides. A round always separates the smallest from the largest value of a
  range, so the search ends, and its answer does not depend on how the data are laid out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from staylens.operators.checks import require_columns
from staylens.runtime import join_sized, materialize, materialize_sized, measure

# Stored counts of which a group may lie in one task, all of them even.
WINDOW_ROWS = 2_000_000
# First round: buckets per factor e of magnitude (neighbours differ by 0.02 percent).
BUCKETS_PER_EFOLD = 4096
# Later rounds: equal slices of a range.
SLICES = 4096


def group_names(by: Sequence[str]) -> list[str]:
    """Internal names of group columns, which no working column can clash with."""
    return [f"_by{i}" for i in range(len(by))]


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(_by..., column, v): one row per value, missing ones as NULL; rows without a
    group are left out."""
    keys = [F.col(f"`{c}`").alias(name) for c, name in zip(by, group_names(by))]
    source = df.na.drop("any", subset=list(by)) if by else df
    if len(cols) == 1:  # keeps the partitioning of a table that is bucketed by the group
        long = source.select(*keys, F.lit(cols[0]).alias("column"), F.col(f"`{cols[0]}`").cast("double").alias("v"))
    else:
        narrow = source.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
        long = narrow.unpivot(group_names(by), [F.col(f"`{c}`") for c in cols], "column", "v")
    return long.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def named_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(group_names(by), by)))


@dataclass(frozen=True)
class ValueTable:
    """Stored counts (_by..., column, v, n); rows that miss the value have a NULL ``v``."""

    counts: DataFrame
    rows: int
    by: tuple[str, ...]

    @property
    def keys(self) -> list[str]:
        return [*group_names(self.by), "column"]

    @property
    def values(self) -> DataFrame:
        return self.counts.where(F.col("v").isNotNull())


def value_table(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> ValueTable:
    """Count every value of the columns, per group: the one scan of ``df``, run at once."""
    require_columns(df, [*cols, *by])
    keys = [*group_names(by), "column"]
    counts = long_values(df, cols, by).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    seen = Observation()
    stored = materialize(counts.observe(seen, F.count(F.lit(1)).alias("rows")))
    return ValueTable(stored, seen.get["rows"], tuple(by))


def _count(values: DataFrame, place: list[str]) -> DataFrame:
    return values.groupBy(*place, "b").agg(
        F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def _running(counts: DataFrame, place: list[str]) -> DataFrame:
    """Adds upto/total, the running and the whole count; a place has few buckets."""
    window = Window.partitionBy(*place)
    upto = window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(
        "*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(window).alias("total")
    )


def _settled(local_rank: Column) -> Column:
    """The value at a rank inside a bucket, or NULL when the bucket must be divided."""
    return (
        F.when((F.col("low") == F.col("high")) | (local_rank == 0), F.col("low"))
        .when(local_rank == F.col("n") - 1, F.col("high"))
    )


def _first_round(values: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    magnitude = F.least(F.log1p(F.abs("v")), F.lit(800.0))
    bucket = F.floor(F.signum("v") * magnitude * BUCKETS_PER_EFOLD).cast("long")
    counts = _running(_count(values.withColumn("b", bucket), keys), keys)
    ranks = []
    for p in probs:
        position = F.lit(float(p)) * (F.col("total") - 1)
        floor = F.floor(position).cast("long")
        for side, rank in ((0, floor), (1, F.ceil(position).cast("long"))):
            ranks.append(
                F.struct(
                    F.lit(float(p)).alias("p"), (position - floor).alias("frac"),
                    F.lit(side).alias("side"), rank.alias("rank"),
                )
            )
    start = F.col("upto") - F.col("n")
    here = F.filter(F.array(*ranks), lambda t: (t["rank"] >= start) & (t["rank"] < F.col("upto")))
    local = F.col("t.rank") - start
    return counts.select("*", F.explode(here).alias("t")).select(
        *keys, "low", "high", "t.p", "t.frac", "t.side", local.alias("rank"),
        _settled(local).alias("value"),
    )


def _next_round(values: DataFrame, keys: list[str], pending: DataFrame, bounded: bool) -> DataFrame:
    """Divide the ranges of ``pending``; at most two ranges per probability and key."""
    pending = pending.drop("value").withColumnsRenamed({"low": "lo", "high": "hi"})
    ranges = pending.select(*keys, "lo", "hi").distinct()
    if bounded:
        ranged = values.join(F.broadcast(ranges), keys)
    else:
        ranged = join_sized(values, measure(ranges), keys, "inner", ["v"])
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    # the ranges of a key do not overlap: a value is in one of them or in none
    part = F.floor((v - lo) / (hi - lo) * SLICES).cast("long")
    sliced = ranged.where((v >= lo) & (v <= hi)).select(*keys, "v", "n", "lo", part.alias("b"))
    place = [*keys, "lo"]
    counts = _running(_count(sliced, place), place)
    asked = F.broadcast(pending) if bounded else pending
    start = F.col("upto") - F.col("n")
    local = F.col("rank") - start
    return (
        counts.join(asked, place)
        .where((local >= 0) & (F.col("rank") < F.col("upto")))
        .select(
            *keys, "low", "high", "p", "frac", "side", local.alias("rank"),
            _settled(local).alias("value"),
        )
    )


def _search_table(values: DataFrame, keys: list[str], step: DataFrame) -> DataFrame:
    """Rounds without group columns: at most 2 * columns * probabilities rows each."""
    spark, schema, settled = values.sparkSession, step.schema, []
    while True:
        ranks = step.collect()
        settled += [r for r in ranks if r["value"] is not None]
        pending = [r for r in ranks if r["value"] is None]
        if not pending:
            return spark.createDataFrame(settled, schema)
        step = _next_round(values, keys, spark.createDataFrame(pending, schema), True)


def _search_groups(values: DataFrame, keys: list[str], step: DataFrame) -> DataFrame:
    """Rounds per group: the ranks of all groups stay in the checkpoint folder."""
    found = None
    while True:
        step = materialize(step)
        settled = step.where(F.col("value").isNotNull())
        found = settled if found is None else found.unionByName(settled)
        pending = step.where(F.col("value").isNull())
        if pending.isEmpty():
            return found
        step = _next_round(values, keys, pending, False)


def _searched(table: ValueTable, probs: Sequence[float]) -> DataFrame:
    """(keys, p, value at the rank below, above, fraction) by narrowing."""
    keys = table.keys
    first = _first_round(table.values, keys, probs)
    found = _search_groups(table.values, keys, first) if table.by else _search_table(table.values, keys, first)
    lower = F.max(F.when(F.col("side") == 0, F.col("value")))
    upper = F.max(F.when(F.col("side") == 1, F.col("value")))
    return found.groupBy(*keys, "p").agg(lower.alias("lower"), upper.alias("upper"), F.max("frac").alias("frac"))


def _between(lower: Column, upper: Column, share: Column) -> Column:
    # equal neighbours give exactly their value, infinities included
    return F.when(lower == upper, lower).otherwise(lower + (upper - lower) * share)


def with_quantiles(table: ValueTable, probs: Sequence[float]) -> DataFrame:
    """The counts with what holds for their group and column: ``total``, ``mean`` and ``q0``, ``q1``, ... per probability.

    ``n`` is 0 where the value is missing. Lazy up to ``WINDOW_ROWS`` counts; beyond, the figures
    are searched at once and joined.
    """
    if any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    keys = table.keys
    n = F.when(F.col("v").isNull(), 0).otherwise(F.col("n"))
    counted = table.counts.withColumn("n", n)
    weighed = F.sum(F.col("v") * F.col("n"))
    if table.rows > WINDOW_ROWS:
        totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.try_divide(weighed, F.sum("n")).alias("mean"))
        found = _searched(table, probs)
        at = [F.max(F.when(F.col("p") == p, _between(F.col("lower"), F.col("upper"), F.col("frac")))) for p in probs]
        wide = found.groupBy(*keys).agg(*[q.alias(f"q{i}") for i, q in enumerate(at)]) if probs else None
        figures = totals if wide is None else totals.join(wide, keys, "left")
        return join_sized(counted, materialize_sized(figures), keys, "inner", ["v"])
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.select(
        "*", F.sum("n").over(upto).alias("_upto"), F.sum("n").over(whole).alias("total"),
        F.try_divide(weighed.over(whole), F.sum("n").over(whole)).alias("mean"),
    )
    columns = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("total") - 1)
        ends = []
        for rank in (F.floor(position), F.ceil(position)):
            here = (rank >= F.col("_upto") - F.col("n")) & (rank < F.col("_upto"))
            ends.append(F.max(F.when(here, F.col("v"))).over(whole))
        columns.append(_between(*ends, position - F.floor(position)).alias(f"q{i}"))
    return placed.select("*", *columns).drop("_upto")


def quantiles_of(table: ValueTable, probs: Sequence[float]) -> DataFrame:
    """Long result (by..., column, p, quantile) of a value table; columns without values are left out."""
    names = [f"q{i}" for i in range(len(probs))]
    wide = with_quantiles(table, probs).groupBy(*table.keys).agg(*[F.max(q).alias(q) for q in names])
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(q).alias("quantile")) for p, q in zip(probs, names)])
    answer = wide.select(*table.keys, F.inline(pairs)).where(F.col("quantile").isNotNull())
    return named_groups(answer, table.by)


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Long result (by..., column, p, quantile); missing values and keys are left out.

    The values are counted when the function is called, in one scan of ``df``.
    """
    require_columns(df, [*cols, *by])
    if any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    return quantiles_of(value_table(df, cols, by), probs)


def approx_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    accuracy: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Same shape from one mergeable sketch per column (``percentile_approx``)."""
    require_columns(df, [*cols, *by])
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    keys = [*group_names(by), "column"]
    answer = (
        long_values(df, cols, by)
        .where(F.col("v").isNotNull())
        .groupBy(*keys)
        .agg(F.percentile_approx("v", [float(p) for p in probs], accuracy).alias("q"))
        .select(*keys, F.explode(F.arrays_zip(wanted.alias("p"), "q")).alias("z"))
        .select(*keys, F.col("z.p").alias("p"), F.col("z.q").alias("quantile"))
    )
    return named_groups(answer, by)


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Exact quantiles, or sketched ones when an ``accuracy`` is given."""
    if accuracy is None:
        return exact_quantiles(df, cols, probs, by)
    return approx_quantiles(df, cols, probs, accuracy, by)


def thresholds(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int | None = None
) -> dict[tuple[str, float], float]:
    """Whole-table quantiles as numbers: one per (column, p), absent for empty columns."""
    rows = quantiles(df, cols, probs, accuracy=accuracy).collect()
    return {(r["column"], r["p"]): r["quantile"] for r in rows}
