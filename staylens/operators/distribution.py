"""Bins, histograms, box-plot figures and correlations: the data behind the charts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import and_

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalars import column, present
from staylens.operators.checks import require_columns
from staylens.operators.profile import is_float
from staylens.operators.quantiles import ValueTable, group_names, quantiles, value_table, with_quantiles
from staylens.operators.stats import number
from staylens.runtime import SizedTable, join_sized, materialize_sized

WHISKER = 1.5


def equal_width_bins(df: DataFrame, col: str, n: int, out: str = "bin") -> DataFrame:
    """Adds the number (1..n) of the right-closed bin of equal width over min..max.

    The minimum is in bin 1, a missing value in none. A column with one value is
    spread 0.1 percent around it, so its rows are in the middle bin.
    """
    require_columns(df, [col])
    value, lo, hi = number(df, col), F.col("lo"), F.col("hi")
    margin = F.when(lo == hi, F.when(lo == 0, 0.001).otherwise(F.abs(lo) * 0.001)).otherwise(0.0)
    grid = (
        df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        .select((lo - margin).alias("low"), ((hi + margin - (lo - margin)) / n).alias("step"))
        .select(F.struct("low", "step").alias("grid"))
        .scalar()
    )
    low, step, v, g = F.col("_grid.low"), F.col("_grid.step"), F.col("_value"), F.col("_guess")
    guess = F.least(F.greatest(F.ceil((v - low) / step) - 1, F.lit(0)), F.lit(n - 1)).cast("int")
    # the quotient may round across an edge: the edges themselves decide
    place = (
        F.when((v <= g * step + low) & (g > 0), g)
        .when((v > (g + 1) * step + low) & (g < n - 1), g + 2)
        .otherwise(g + 1)
    )
    return (
        df.withColumns({"_value": value, "_grid": grid})
        .withColumn("_guess", guess)
        .withColumn(out, F.when(v.isNotNull(), place).cast("int"))
        .drop("_value", "_grid", "_guess")
    )


def mean_by_bin(df: DataFrame, col: str, value: str, n: int) -> DataFrame:
    """(bin, mean) for bins 1..n; a bin without rows has a NULL mean."""
    require_columns(df, [col, value])
    binned = equal_width_bins(df.select(column(col), column(value)), col, n, "bin")
    found = binned.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.avg(number(df, value)).alias("mean")
    )
    bins = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(found), "bin", "left")  # found has at most n rows


def _edge(i: Column, low: Column, high: Column, bins: int) -> Column:
    return i.cast("double") * ((high - low) / bins) + low


def _ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of structs ``r_i`` (column, lo, hi); a column with one value is spread by a half on either side."""
    ranges = [F.min(number(df, c)).alias(f"lo_{i}") for i, c in enumerate(cols)]
    ranges += [F.max(number(df, c)).alias(f"hi_{i}") for i, c in enumerate(cols)]
    spread = []
    for i, c in enumerate(cols):
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        spread.append(
            F.struct(
                F.lit(c).alias("column"),
                F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
                F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
            ).alias(f"r_{i}")
        )
    return df.agg(*ranges).select(*spread)


def _binned(df: DataFrame, cols: Sequence[str], bounds: DataFrame, bins: int) -> DataFrame:
    """The number of each value's bin, one column per column."""
    guesses, places = {}, {}
    for i, c in enumerate(cols):
        v, g = F.col(f"_value_{i}"), F.col(f"_guess_{i}")
        low, high = F.col(f"_s.r_{i}.lo"), F.col(f"_s.r_{i}.hi")
        guesses[f"_guess_{i}"] = F.least(
            F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)
        ).cast("int")
        # the quotient may round across an edge: the edges themselves decide
        places[c] = (
            F.when(v.isNull(), None)  # least() above skips a missing value
            .when(v < _edge(g, low, high, bins), g)
            .when((v >= _edge(g + 1, low, high, bins)) & (g < bins - 1), g + 2)
            .otherwise(g + 1)
        )
    return (
        df.select(
            *[number(df, c).alias(f"_value_{i}") for i, c in enumerate(cols)],
            bounds.select(F.struct(*bounds.columns).alias("s")).scalar().alias("_s"),
        )
        .withColumns(guesses)
        .select(*[place.alias(c) for c, place in places.items()])
    )


def histogram(df: DataFrame, cols: str | Sequence[str], bins: int = 10) -> DataFrame:
    """(column, bin, lower, upper, n): left-closed bins, the last one closed.

    Bins without rows are listed with n = 0. A column with one value is spread by a
    half on either side. One pass finds the ranges, one pass counts.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    require_columns(df, cols)
    bounds = _ranges(df, cols)
    counted = (
        _binned(df, cols, bounds, bins)
        .unpivot([], [column(c) for c in cols], "column", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    lo, hi, b = F.col("lo"), F.col("hi"), F.col("bin")
    every = (
        bounds.select(F.inline(F.array(*bounds.columns)))
        .where(lo.isNotNull())
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
        .select(
            "column", "bin", _edge(b - 1, lo, hi, bins).alias("lower"),
            F.when(b == bins, hi).otherwise(_edge(b, lo, hi, bins)).alias("upper"),
        )
    )
    # counted has at most bins rows per requested column
    return every.join(F.broadcast(counted), ["column", "bin"], "left").select(
        "column", "bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def joint_histogram(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """(a, b, bin_a, bin_b, lower_a, lower_b, n): a grid of counts for every pair of columns.

    What a plot of all pairs shows, from all rows instead of a sample. Bins are those of
    :func:`histogram`; cells without rows are not listed, and a row counts for the pairs of
    which it has both values. Rows are counted by all their bins first, so what is dealt to
    pairs are distinct combinations of bins.
    """
    require_columns(df, cols)
    cols = list(dict.fromkeys(cols))
    bounds = _ranges(df, cols)
    names = [f"_bin_{i}" for i in range(len(cols))]
    binned = _binned(df, cols, bounds, bins).toDF(*names)
    combined = binned.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    dealt = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(names[i]).alias("bin_a"), F.col(names[j]).alias("bin_b"))
        for (i, a), (j, b) in combinations(enumerate(cols), 2)
    ]
    cells = combined.select(F.inline(F.array(*dealt)), "n").where("bin_a is not null and bin_b is not null")
    counted = cells.groupBy("a", "b", "bin_a", "bin_b").agg(F.sum("n").alias("n"))
    # one row per column asked for
    edges = F.broadcast(bounds.select(F.inline(F.array(*bounds.columns))))
    for side in "ab":
        edge = edges.select(F.col("column").alias(side), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}"))
        counted = counted.join(edge, side)
    lower = [_edge(F.col(f"bin_{x}") - 1, F.col(f"lo_{x}"), F.col(f"hi_{x}"), bins).alias(f"lower_{x}") for x in "ab"]
    return counted.select("a", "b", "bin_a", "bin_b", *lower, "n")


def _with_fences(table: ValueTable) -> DataFrame:
    """The counted values of each group with its quartiles and fences."""
    spread = with_quantiles(table, [0.25, 0.5, 0.75]).withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"})
    reach = (F.col("q75") - F.col("q25")) * WHISKER
    return spread.where("n > 0").withColumns({"low_fence": F.col("q25") - reach, "high_fence": F.col("q75") + reach})


def _sketched(df: DataFrame, key: str, value: str, accuracy: int) -> SizedTable:
    """(key, quartiles, fences) of each group from a sketch."""
    found = quantiles(df, [value], [0.25, 0.5, 0.75], [key], accuracy)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("quantile")))
    wide = found.groupBy(column(key).alias(key)).agg(at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"))
    reach = (F.col("q75") - F.col("q25")) * WHISKER
    return materialize_sized(wide.withColumns({"low_fence": F.col("q25") - reach, "high_fence": F.col("q75") + reach}))


def _valued(df: DataFrame, key: str, value: str) -> DataFrame:
    rows = df.where(column(key).isNotNull() & present(value, is_float(df, value)))
    return rows.withColumn("_v", column(value).cast("double"))


def box_stats(df: DataFrame, key: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Quartiles, whiskers and number of outliers per group.

    A whisker ends at the last value within 1.5 interquartile ranges of the box, and
    at the box itself when there is none. One scan of ``df``; with ``accuracy`` two.
    """
    require_columns(df, [key, value])
    narrow = df.select(column(key), column(value))
    if accuracy is None:
        return box_values(value_table(narrow, [value], [key]))
    rows = join_sized(_valued(narrow, key, value), _sketched(narrow, key, value, accuracy), [key], "inner", ["_v"])
    return _boxes(rows.select(column(key).alias("_key"), "_v", F.lit(1).alias("n"), "q25", "median", "q75", "low_fence", "high_fence"), key)


def box_values(table: ValueTable) -> DataFrame:
    """What :func:`box_stats` gives, from the values of one column that are counted by one key already."""
    (key,) = table.by
    return _boxes(_with_fences(table).withColumnsRenamed({group_names([key])[0]: "_key", "v": "_v"}), key)


def _boxes(rows: DataFrame, key: str) -> DataFrame:
    inside = F.col("_v").between(F.col("low_fence"), F.col("high_fence"))
    ends = rows.groupBy("_key", "q25", "median", "q75").agg(
        F.sum("n").cast("long").alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("lo"),
        F.max(F.when(inside, F.col("_v"))).alias("hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).cast("long").alias("outliers"),
    )
    return ends.select(
        F.col("_key").alias(key), "n", "q25", "median", "q75",
        F.least("lo", "q25").alias("whisker_low"),
        F.greatest("hi", "q75").alias("whisker_high"),
        "outliers",
    )


def box_outliers(df: DataFrame, key: str, value: str, accuracy: int | None = None) -> DataFrame:
    """The rows beyond the whiskers of their group: one scan for the fences, one for the rows."""
    require_columns(df, [key, value])
    if accuracy is None:
        group = group_names([key])[0]
        fences = _with_fences(value_table(df, [value], [key])).groupBy(F.col(group).alias(key)).agg(
            F.any_value("low_fence").alias("low_fence"), F.any_value("high_fence").alias("high_fence")
        )
        fences = materialize_sized(fences)
    else:
        fences = _sketched(df, key, value, accuracy)
    rows = join_sized(_valued(df, key, value), fences, [key], "inner", df.columns)
    return rows.where(~F.col("_v").between(F.col("low_fence"), F.col("high_fence"))).select(
        *[column(c) for c in df.columns]
    )


def _pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows that have both values; NULL when one is constant.

    The three sums skip incomplete pairs themselves and are merged from partial sums
    of squared deviations. (``corr`` would divide by zero on a constant column.)
    """
    spread = F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b))
    return F.try_divide(F.regr_sxy(a, b), spread)


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (r)."""
    require_columns(df, [a, b])
    return df.agg(_pearson(number(df, a), number(df, b)).alias("r"))


# Sums of a pair of columns (x, y) over the rows that have both: number, x, y, xx, yy, xy.
PAIR_SUMS = 6
# A spread below this share of the squares it is taken from is rounding.
CONSTANT = 1e-12


def _pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r) of the pairs, from one mergeable row of masked sums; no row is multiplied.

    Values are taken relative to their column's mean, so that the sums of squares lose no digits.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(cols)}
    numbers = [number(df, c) for c in cols]
    centre = df.agg(F.struct(*[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m{i}") for i, x in enumerate(numbers)]).alias("s")).scalar()
    values = df.select(*[x.alias(f"v{i}") for i, x in enumerate(numbers)], centre.alias("c"))
    masked = values.select(
        *[F.coalesce(F.col(f"v{i}") - F.col(f"c.m{i}"), F.lit(0.0)).alias(f"x{i}") for i in range(len(cols))],
        *[F.col(f"v{i}").isNotNull().cast("double").alias(f"h{i}") for i in range(len(cols))],
    )
    products = []
    for a, b in pairs:
        x, y, hx, hy = (F.col(f"{kind}{place[c]}") for kind in "xh" for c in (a, b))
        products += [hx * hy, x * hy, y * hx, x * x * hy, y * y * hx, x * y]
    # a row of zeros, which changes no sum, gives an empty table sums as well
    nothing = df.sparkSession.range(0, 1, 1, 1).select(F.array(*[F.lit(0.0)] * len(products)).alias("s"))
    rows = masked.select(F.array(*products).alias("s")).unionAll(nothing)
    sums = rows.select(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    results = []
    for k, (a, b) in enumerate(pairs):
        n, x, y, xx, yy, xy = (F.col("s")[PAIR_SUMS * k + j] for j in range(PAIR_SUMS))
        spread_x, spread_y = xx - F.try_divide(x * x, n), yy - F.try_divide(y * y, n)
        r = F.try_divide(xy - F.try_divide(x * y, n), F.sqrt(spread_x) * F.sqrt(spread_y))
        varies = (spread_x > CONSTANT * xx) & (spread_y > CONSTANT * yy)
        r = F.lit(1.0) if a == b else F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))
        results.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(varies, r).alias("r")))
    return sums.select(F.inline(F.array(*results)))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for every ordered pair, from one aggregate over the rows.

    Rows that miss a value of a pair are left out of that pair only. The diagonal is 1
    except for a constant column, where r is NULL.
    """
    require_columns(df, cols)
    cols = list(dict.fromkeys(cols))
    found = _pair_correlations(df, list(combinations_with_replacement(cols, 2)))
    mirrored = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "r"))).otherwise(
        F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    )
    return found.select(F.inline(mirrored))


def strong_correlates(
    df: DataFrame, cols: Sequence[str], target: str, above: float = 0.5
) -> DataFrame:
    """(column, r) of the columns whose correlation with the target exceeds ``above``.

    The target itself is one of them (r = 1). Only its own pairs are computed.
    """
    require_columns(df, [*cols, target])
    found = _pair_correlations(df, [(target, c) for c in dict.fromkeys([*cols, target])])
    return found.where(F.col("r") > above).select(F.col("b").alias("column"), "r")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, vif): the variance inflation factor of each column given the others.

    Rows with all values count. A column that the others determine, or that is constant,
    has NULL. Only the correlations, one number per pair of columns, come to the driver.
    """
    require_columns(df, cols)
    cols = list(dict.fromkeys(cols))
    whole = reduce(and_, [number(df, c).isNotNull() for c in cols])
    pairs = correlation_matrix(df.where(whole), cols).collect()
    known = {(x["a"], x["b"]): x["r"] for x in pairs}
    varied = [c for c in cols if known[c, c] is not None]
    rows = []
    for c in cols:
        factor = None
        if c in varied:
            others = [o for o in varied if o != c]
            mine = np.array([known[c, o] for o in others])
            between = np.array([[known[o, u] for u in others] for o in others]).reshape(len(others), len(others))
            left = 1.0 - float(mine @ np.linalg.pinv(between, rcond=1e-10, hermitian=True) @ mine) if others else 1.0
            factor = 1.0 / left if left > 1e-9 else None
        rows.append((c, factor))
    return df.sparkSession.createDataFrame(rows, "column string, vif double")


def scatter_sample(df: DataFrame, key: str, cols: Sequence[str], n: int) -> DataFrame:
    """A repeatable sample of n rows (key, cols...) for a scatter plot, by key hash."""
    require_columns(df, [key, *cols])
    order = F.md5(column(key).cast("string"))
    return df.orderBy(order, column(key)).limit(n).select(column(key), *[column(c) for c in cols])
