"""Group statistics. Every grouped mean or count combines map-side before it shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalars import column, present, quantile_band
from staylens.operators.checks import require_columns
from staylens.operators.profile import is_float
from staylens.operators.quantiles import thresholds, value_table, with_quantiles
from staylens.runtime import join_sized, materialize, materialize_sized


def number(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN read as missing."""
    value = column(name).cast("double")
    return F.nanvl(value, F.lit(None).cast("double")) if is_float(df, name) else value


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.where(column(key).isNotNull())


def mean_by(df: DataFrame, key: str, value: str, out: str = "mean", sort: str | None = None) -> DataFrame:
    """(key, mean); rows without a key are left out.

    ``sort`` orders by the mean, ``"desc"`` or ``"asc"``: ties by key, missing means last.
    """
    require_columns(df, [key, value])
    if sort not in (None, "asc", "desc"):
        raise ValueError("sort is 'asc' or 'desc'")
    means = _keyed(df, key).groupBy(column(key).alias(key)).agg(F.avg(number(df, value)).alias(out))
    if sort is None:
        return means
    order = column(out).desc_nulls_last() if sort == "desc" else column(out).asc_nulls_last()
    return means.orderBy(order, column(key))


def mean_by_each(df: DataFrame, keys: Sequence[str], value: str, out: str = "mean") -> DataFrame:
    """(key, group, mean) for several keys from one scan."""
    require_columns(df, [*keys, value])
    narrow = df.select(*[column(k).cast("string").alias(k) for k in keys], number(df, value).alias("_v"))
    long = narrow.unpivot(["_v"], [column(k) for k in keys], "key", "group")
    return long.where(F.col("group").isNotNull()).groupBy("key", "group").agg(F.avg("_v").alias(out))


def mode_by(df: DataFrame, key: str, value: str, out: str = "mode") -> DataFrame:
    """(key, mode): the most frequent value of each group; ties give the smallest."""
    require_columns(df, [key, value])
    counts = (
        df.where(column(key).isNotNull() & present(value, is_float(df, value)))
        .groupBy(column(key).alias("_k"), column(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min_by("_v", F.struct(-F.col("_n"), F.col("_v")))
    return counts.groupBy("_k").agg(best.alias("_best")).select(
        F.col("_k").alias(key), F.col("_best").alias(out)
    )


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """(col, n), most frequent first, ties by value; ``k`` keeps the first k."""
    require_columns(df, [col])
    counts = (
        df.where(present(col, is_float(df, col)))
        .groupBy(column(col).alias(col))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column(col))
    )
    return counts if k is None else counts.limit(k)


def distinct_count(df: DataFrame, col: str, approx: bool = False, out: str = "distinct") -> DataFrame:
    require_columns(df, [col])
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(count(column(col)).alias(out))


def means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mean) from one aggregate."""
    require_columns(df, cols)
    wide = df.agg(*[F.avg(number(df, c)).alias(c) for c in cols])
    return wide.unpivot([], [column(c) for c in cols], "column", "mean")


def mean_and_median(df: DataFrame, col: str) -> DataFrame:
    """One row (mean, median), from one scan."""
    spread = with_quantiles(value_table(df, [col]), [0.5])
    return spread.agg(F.max("mean").alias("mean"), F.max("q0").alias("median"))


def top_bottom(df: DataFrame, key: str, value: str, k: int = 5) -> DataFrame:
    """The k highest and k lowest rows of a keyed result, labelled by ``side``.

    With fewer than 2k groups a row may be on both sides. Rows without a value
    belong to neither.
    """
    require_columns(df, [key, value])
    ranked = df.where(column(value).isNotNull())
    top = ranked.orderBy(column(value).desc(), column(key)).limit(k)
    bottom = ranked.orderBy(column(value), column(key).desc()).limit(k)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


def keep_top_categories(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose category is one of the k most frequent.

    The categories are counted and stored when this is called.
    """
    top = materialize_sized(value_counts(df, col, k).select(column(col)))
    return join_sized(df, top, [col], "left_semi", df.columns)


def rating_bands(
    df: DataFrame,
    cols: Sequence[str],
    low: float = 0.25,
    high: float = 0.75,
    suffix: str = "_band",
    accuracy: int | None = None,
) -> DataFrame:
    """Adds High/Medium/Low per column, cut at the column's own quantiles."""
    require_columns(df, cols)
    cuts = thresholds(df, cols, [low, high], accuracy)
    return df.withColumns(
        {
            c + suffix: quantile_band(
                column(c).cast("double"), cuts.get((c, float(low))), cuts.get((c, float(high)))
            )
            for c in cols
        }
    )


def quantile_tails(
    df: DataFrame, col: str, low: float = 0.05, high: float = 0.95, accuracy: int | None = None
) -> DataFrame:
    """Rows at or beyond the quantiles, labelled ``tail`` = high/low.

    A row that is on both sides (all values equal) appears once per side.
    """
    require_columns(df, [col])
    cuts = thresholds(df, [col], [low, high], accuracy)
    value = number(df, col)
    lower, upper = (F.lit(cuts.get((col, float(p)))).cast("double") for p in (low, high))
    sides = F.filter(
        F.array(F.when(value >= upper, F.lit("high")), F.when(value <= lower, F.lit("low"))),
        lambda side: side.isNotNull(),
    )
    return df.select("*", F.explode(sides).alias("tail"))


def subset_profile(
    df: DataFrame,
    predicate: Column,
    distinct: str,
    categories: Sequence[str],
    measures: Sequence[str],
    k: int = 5,
) -> DataFrame:
    """(metric, key, value) of the rows that satisfy ``predicate``.

    Row count, distinct ``distinct`` values, the k most common values of each
    category and the mean of each measure. All parts come from one pass with a grouping set
    each, which runs when this is called; its groups are stored, the result is lazy.
    """
    require_columns(df, [distinct, *categories, *measures])
    wanted = [distinct, *categories]
    names = [f"_g{i}" for i in range(len(wanted))]
    rows = df.where(predicate).select(
        *[column(c).alias(g) for c, g in zip(wanted, names)], *[number(df, c).alias(f"_m{i}") for i, c in enumerate(measures)]
    )
    sets = [[], *[[F.col(g)] for g in names]]
    groups = rows.groupingSets(sets, *names).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), *[F.avg(f"_m{i}").alias(f"_m{i}") for i in range(len(measures))]
    )
    # grouping_id has a bit per name, the first one highest, 0 for the names of the set
    full = 2 ** len(names) - 1
    bit = [full - 2 ** (len(names) - 1 - i) for i in range(len(names))]
    groups = materialize(groups)
    found = (F.col("_set") == bit[0]) & present(names[0], is_float(rows, names[0]))
    whole = groups.agg(
        F.coalesce(F.max(F.when(F.col("_set") == full, F.col("n"))), F.lit(0)).cast("double").alias("rows"),
        F.count_if(found).cast("double").alias("distinct"),
        *[F.max(F.when(F.col("_set") == full, F.col(f"_m{i}"))).alias(f"_m{i}") for i in range(len(measures))],
    )
    labels = [("row_count", None, "rows"), ("distinct_count", distinct, "distinct")]
    labels += [("mean", c, f"_m{i}") for i, c in enumerate(measures)]
    entries = [
        F.struct(F.lit(metric).alias("metric"), F.lit(key).cast("string").alias("key"), F.col(name).alias("value"))
        for metric, key, name in labels
    ]
    result = whole.select(F.inline(F.array(*entries)))
    for g, b, c in zip(names[1:], bit[1:], categories):
        present_ones = groups.where((F.col("_set") == b) & present(g, is_float(rows, g)))
        top = present_ones.orderBy(F.desc("n"), F.col(g)).limit(k)
        result = result.unionByName(
            top.select(F.lit(f"top_{c}").alias("metric"), F.col(g).cast("string").alias("key"), F.col("n").cast("double").alias("value"))
        )
    return result


def area_profile(
    df: DataFrame, key: str, averages: dict[str, str], modes: dict[str, str], by_parts: bool = False
) -> DataFrame:
    """One row per key: the mean of each column in ``averages`` and the most frequent
    value of each column in ``modes`` (both: result name -> column).

    One pass over ``df`` with a grouping set per part; its groups are put together by the key,
    without a join. On a table that is bucketed by the key, ``by_parts=True`` needs no exchange
    instead: a scan per part, joined on the key.
    """
    require_columns(df, [key, *averages.values(), *modes.values()])
    if by_parts:
        profile = _keyed(df, key).groupBy(column(key).alias(key)).agg(
            *[F.avg(number(df, c)).alias(name) for name, c in averages.items()]
        )
        for name, c in modes.items():
            profile = profile.join(mode_by(df, key, c, name), key, "left")  # all keys are in the profile
        return profile
    names = [f"_g{i}" for i in range(len(modes))]
    rows = _keyed(df, key).select(
        column(key).alias("_k"), *[column(c).alias(g) for c, g in zip(modes.values(), names)],
        *[number(df, c).alias(f"_m{i}") for i, c in enumerate(averages.values())],
    )
    sets = [[F.col("_k")], *[[F.col("_k"), F.col(g)] for g in names]]
    groups = rows.groupingSets(sets, "_k", *names).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), *[F.avg(f"_m{i}").alias(f"_m{i}") for i in range(len(averages))]
    )
    full = 2 ** len(names) - 1
    parts = [F.max(F.when(F.col("_set") == full, F.col(f"_m{i}"))).alias(name) for i, name in enumerate(averages)]
    for i, (name, g) in enumerate(zip(modes, names)):
        here = (F.col("_set") == full - 2 ** (len(names) - 1 - i)) & present(g, is_float(rows, g))
        parts.append(F.min_by(g, F.when(here, F.struct(-F.col("n"), F.col(g)))).alias(name))
    return groups.groupBy("_k").agg(*parts).withColumnRenamed("_k", key)


def area_extremes(profile: DataFrame, key: str, rank_by: str, k: int = 5) -> DataFrame:
    """The profile of the k best and k worst areas, ranked from 1 within ``side``.

    The profile is computed once and stored when this is called.
    """
    require_columns(profile, [key, rank_by])
    picked = materialize(top_bottom(materialize(profile), key, rank_by, k))
    value = F.when(F.col("side") == "top", -column(rank_by)).otherwise(column(rank_by))
    # at most 2k rows; ties: top by key upwards, bottom by key downwards
    places = picked.groupBy("side").agg(
        F.array_sort(F.collect_list(F.struct(value.alias("order"), column(key).alias("key")))).alias("s")
    )
    ranked = places.select("side", F.posexplode("s").alias("pos", "place")).select(
        "side", F.col("place.key").alias(key), (F.col("pos") + 1).alias("rank")
    )
    return picked.join(F.broadcast(ranked), ["side", key])
