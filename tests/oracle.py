"""Compare a query with its SQL, order-insensitively and exactly."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both agree, else the first difference."""
    found = query(spark, sf_dir)
    ours = _rows(found.columns, [tuple(r) for r in found.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)} != {sorted(names)}"
    theirs = _rows(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} != {b}"
    return None
