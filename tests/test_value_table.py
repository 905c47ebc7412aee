"""Figures that come from one scan: counted values, pair moments, grouping sets, grids."""

import collections
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from staylens.operators import distribution, features, profile, quantiles, stats

NAN = float("nan")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def measured(spark):
    r = random.Random(2)
    data = []
    for i in range(3000):
        group = "hot" if i % 3 else r.choice(["a", "b", None])
        x = r.choice([NAN, None, float(r.randint(1, 9)), r.lognormvariate(0, 4)])
        data.append((i, group, x, r.gauss(1e6, 1.0), r.choice([0.1, 0.1, None]), -r.random() if i % 7 else None))
    data.append((3000, "none", None, 5.0, 0.1, 1.0))
    schema = "id long, `the group` string, x double, y double, same double, z double"
    return data, spark.createDataFrame(data, schema).repartition(6)


@pytest.mark.parametrize("window_rows", [quantiles.WINDOW_ROWS, 0])
def test_describe_by_window_and_by_search(measured, monkeypatch, window_rows):
    monkeypatch.setattr(quantiles, "WINDOW_ROWS", window_rows)
    data, df = measured
    found = {(r["the group"], r["column"]): r for r in profile.describe_by(df, "the group", ["x", "y"]).collect()}
    assert set(found) == {(g, c) for g in ("hot", "a", "b", "none") for c in "xy"}
    for (g, c), r in found.items():
        v = [d[2 if c == "x" else 3] for d in data if d[1] == g]
        v = np.array([x for x in v if x is not None and not math.isnan(x)])
        assert r["count"] == len(v)
        if len(v):
            want = [v.mean(), v.min(), *np.quantile(v, [0.25, 0.5, 0.75]), v.max()]
            assert [r[k] for k in ("mean", "min", "q25", "median", "q75", "max")] == pytest.approx(want, rel=1e-9)
        if len(v) > 1:
            assert r["std"] == pytest.approx(v.std(ddof=1), rel=1e-6)
        else:
            assert r["std"] is None and r["median"] == (v[0] if len(v) else None)


@pytest.mark.parametrize("window_rows", [quantiles.WINDOW_ROWS, 0])
def test_box_stats_by_window_and_by_search(spark, monkeypatch, window_rows):
    monkeypatch.setattr(quantiles, "WINDOW_ROWS", window_rows)
    data = [("a", float(x)) for x in [1, 2, 3, 4, 5, 100, -80, 3, 3]] + [("b", 7.0)] * 4 + [("c", None), (None, 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    assert rows(distribution.box_stats(df, "k", "v")) == [("a", 9, 2.0, 3.0, 4.0, 1.0, 5.0, 2), ("b", 4, 7.0, 7.0, 7.0, 7.0, 7.0, 0)]
    assert rows(distribution.box_outliers(df, "k", "v")) == [("a", -80.0), ("a", 100.0)]


def test_results_read_stored_counts_only(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for found in (
        profile.describe_by(lines, "l_suppkey", ["l_extendedprice", "l_discount"]),
        quantiles.quantiles(lines, ["l_quantity", "l_tax"], [0.1, 0.9]),
        distribution.box_stats(lines, "l_returnflag", "l_extendedprice"),
        stats.mean_and_median(lines, "l_tax"),
    ):
        assert "FileScan" not in plan_of(found)
    table = quantiles.long_values(lines, ["l_quantity", "l_tax"])
    assert plan_of(table).count("FileScan") == 1


def test_pair_moments_without_generate(measured):
    data, df = measured
    found = distribution.correlation_matrix(df, ["x", "y", "same", "z"])
    # the only Generate unfolds the one row of results
    assert plan_of(found).index("Generate") < plan_of(found).index("Aggregate") and plan_of(found).count("Generate") == 2
    r = {(x["a"], x["b"]): x["r"] for x in found.collect()}
    assert len(r) == 16
    columns = {c: np.array([NAN if d[i] is None else d[i] for d in data]) for c, i in (("x", 2), ("y", 3), ("same", 4), ("z", 5))}
    for a in columns:
        for b in columns:
            both = ~np.isnan(columns[a]) & ~np.isnan(columns[b])
            if "same" in (a, b):
                assert r[a, b] is None
            else:
                assert r[a, b] == pytest.approx(np.corrcoef(columns[a][both], columns[b][both])[0, 1], abs=1e-9), (a, b)


def test_pair_moments_of_hard_columns(spark):
    data = [(1e12 + i, 1e-9 * i * i, 0.3, float(i) if i < 2 else None, float(-i)) for i in range(50)]
    df = spark.createDataFrame(data, "big double, tiny double, same double, few double, down double")
    r = {(x["a"], x["b"]): x["r"] for x in distribution.correlation_matrix(df, df.columns).collect()}
    i = np.arange(50)
    assert r["big", "tiny"] == pytest.approx(np.corrcoef(i, i * i)[0, 1], abs=1e-9) and r["big", "down"] == pytest.approx(-1.0)
    assert r["few", "down"] == pytest.approx(-1.0) and r["same", "same"] is None and r["same", "big"] is None
    empty = distribution.correlation_matrix(df.where("big < 0"), ["big", "tiny"])
    assert [x["r"] for x in empty.collect()] == [None] * 4


def test_strong_correlates_of_one_column(measured):
    _, df = measured
    found = rows(distribution.strong_correlates(df.withColumn("w", F.col("z") * 2), ["x", "w"], "z", 0.9))
    assert [(c, pytest.approx(1.0)) for c in ("w", "z")] == found


def test_vif(spark):
    r = np.random.default_rng(3)
    a, b, e = r.normal(size=(3, 400))
    data = np.stack([a, b, a + 0.5 * e, np.full(400, 2.0)], 1)
    df = spark.createDataFrame([tuple(map(float, x)) for x in data] + [(None, 1.0, 1.0, 2.0)], "a double, b double, c double, k double")
    found = {x["column"]: x["vif"] for x in distribution.vif(df, ["a", "b", "c", "k"]).collect()}
    inverse = np.diag(np.linalg.inv(np.corrcoef(data[:, :3].T)))
    assert [found[c] for c in "abc"] == pytest.approx(list(inverse)) and found["k"] is None
    twice = df.withColumn("d", F.col("a") * 2 - 1)
    found = {x["column"]: x["vif"] for x in distribution.vif(twice, ["a", "b", "d"]).collect()}
    assert found["a"] is None and found["d"] is None and found["b"] == pytest.approx(1.0, abs=0.05)


def test_joint_histogram_against_numpy(spark):
    r = random.Random(9)
    data = [(r.choice([None, NAN, r.random()]), float(r.randint(0, 5)), r.gauss(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(3)
    cells = collections.Counter()
    edges = {}
    for x in distribution.joint_histogram(df, ["a", "b", "c"], 6).collect():
        cells[x["a"], x["b"], x["bin_a"], x["bin_b"]] += x["n"]
        edges[x["a"], x["bin_a"]] = x["lower_a"]
    for (i, a), (j, b) in [((0, "a"), (1, "b")), ((0, "a"), (2, "c")), ((1, "b"), (2, "c"))]:
        both = [(d[i], d[j]) for d in data if not any(v is None or math.isnan(v) for v in (d[i], d[j]))]
        span = [[min(v) , max(v)] for v in ([d[k] for d in data if d[k] is not None and not math.isnan(d[k])] for k in (i, j))]
        grid, low, _ = np.histogram2d(*zip(*both), bins=6, range=span)
        want = {(a, b, p + 1, q + 1): int(grid[p, q]) for p in range(6) for q in range(6) if grid[p, q]}
        assert {k: n for k, n in cells.items() if k[:2] == (a, b)} == want
        assert all(edges[a, p] == pytest.approx(low[p - 1]) for x, p in edges if x == a)


def test_histogram_leaves_missing_values_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (NAN,)], "a double")
    assert [(r["bin"], r["n"]) for r in distribution.histogram(df, "a", 2).orderBy("bin").collect()] == [(1, 1), (2, 1)]


def test_oversample_shares_and_repeats(spark):
    data = [(i, "big" if i < 900 else "small" if i < 1100 else None) for i in range(1110)]
    df = spark.createDataFrame(data, "id long, label string")
    found = features.oversample(df, "label", "id")
    counts = collections.Counter(r["label"] for r in found.collect())
    assert counts["big"] == 900 and counts[None] == 10 and 840 <= counts["small"] <= 960
    assert rows(found) == rows(features.oversample(df.repartition(7), "label", "id"))
    assert collections.Counter(r["copy"] for r in features.oversample(df, "label", "id", 0.2).collect()) == {0: 1110}


def test_area_profile_in_one_pass(spark):
    data = [("x", 1.0, "p", "u"), ("x", None, "q", "u"), ("x", 3.0, "q", "v"), ("y", NAN, None, "v"), (None, 1.0, "p", "u"), ("y", None, None, "u")]
    df = spark.createDataFrame(data, "`k` string, m double, c string, e string")
    parts = [stats.area_profile(df, "k", {"mean": "m"}, {"common": "c", "kind": "e"}, by_parts=p) for p in (False, True)]
    assert rows(parts[0]) == rows(parts[1]) == [("x", 2.0, "q", "u"), ("y", None, None, "u")]
    assert plan_of(parts[0]).count("Join") == 0
    assert rows(stats.area_profile(df, "k", {"mean": "m"}, {})) == [("x", 2.0), ("y", None)]


def test_area_profile_reads_its_source_once(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = stats.area_profile(lines, "l_suppkey", {"price": "l_extendedprice"}, {"flag": "l_returnflag", "mode": "l_shipmode"} if "l_shipmode" in lines.columns else {"flag": "l_returnflag"})
    assert plan_of(found).count("FileScan") == 1
    assert "FileScan" not in plan_of(stats.area_extremes(found, "l_suppkey", "price"))


def test_subset_profile_of_nothing(spark):
    df = spark.createDataFrame([("a", "p", 1.0)], "id string, c string, m double")
    found = rows(stats.subset_profile(df, F.lit(False), "id", ["c"], ["m"]))
    assert found == [("distinct_count", "id", 0.0), ("mean", "m", None), ("row_count", None, 0.0)]
    assert rows(stats.subset_profile(df, F.lit(True), "id", ["c", "id"], [])) == [
        ("distinct_count", "id", 1.0), ("row_count", None, 1.0), ("top_c", "p", 1.0), ("top_id", "a", 1.0),
    ]
