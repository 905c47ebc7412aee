"""Argument checks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise when a named column does not exist; Spark's ``drop`` would ignore it."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; the table has {df.columns}")
