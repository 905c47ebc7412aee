"""Cleaning: columns, types, filters and incomplete rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from staylens.functions.scalars import column, percent_to_ratio, present, to_number
from staylens.operators.checks import require_columns


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; an unknown name is an error."""
    require_columns(df, cols)
    return df.drop(*cols)


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    return df.withColumns({c: to_number(c) for c in cols})


def coerce_percent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    return df.withColumns({c: percent_to_ratio(c) for c in cols})


def filter_min(df: DataFrame, col: str, least: float) -> DataFrame:
    """Rows with ``col >= least``; missing values go."""
    require_columns(df, [col])
    return df.where((column(col) >= least) & _present(df, col))


def filter_equal(df: DataFrame, col: str, value) -> DataFrame:
    require_columns(df, [col])
    return df.where(column(col) == value)


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with a value in every column, or in every column of ``subset``."""
    cols = list(subset if subset is not None else df.columns)
    require_columns(df, cols)
    for c in cols:
        df = df.where(_present(df, c))
    return df


def _present(df: DataFrame, name: str):
    return present(name, isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)))


def normalize_names(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores for spaces; two equal results are an error."""
    names = [c.lower().replace(" ", "_") for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"columns would share a name: {repeated}")
    return df.toDF(*names)


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    return df.select(*[column(c) for c in cols])


def join_with_suffix(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_left", "_right"),
) -> DataFrame:
    """Join on explicit keys; other columns that both sides have get a suffix."""
    require_columns(left, on)
    require_columns(right, on)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, list(on), how)
