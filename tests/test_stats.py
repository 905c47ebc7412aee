import numpy as np
import pandas as pd
import pytest
from conftest import rows
from data import reviews
from pyspark.sql import functions as F
from test_profile_clean import frame

from staylens.operators import distribution, stats


def clean_dict(series):
    return {k: (None if pd.isna(v) else v) for k, v in series.items()}


def test_means(spark):
    found = dict(rows(stats.mean_by(reviews(spark), "neighbourhood", "overall_rating")))
    assert found == pytest.approx(clean_dict(frame().groupby("neighbourhood")["overall_rating"].mean()))
    each = stats.mean_by_each(reviews(spark), ["room_type", "is_superhost"], "overall_rating").collect()
    for key in ("room_type", "is_superhost"):
        want = clean_dict(frame().groupby(key)["overall_rating"].mean())
        assert {r["group"]: r["mean"] for r in each if r["key"] == key} == pytest.approx(want)
    found = dict(rows(stats.means(reviews(spark), ["overall_rating", "value_rating"])))
    assert found == pytest.approx(frame()[["overall_rating", "value_rating"]].mean().to_dict())
    both = stats.mean_and_median(reviews(spark), "overall_rating").first()
    pdf = frame()["overall_rating"]
    assert (both["mean"], both["median"]) == pytest.approx((pdf.mean(), pdf.median()))


def test_modes_and_ties(spark):
    df = spark.createDataFrame(
        [("a", "y"), ("a", "x"), ("b", "z"), ("b", "z"), ("b", "a"), ("b", None), (None, "q"), ("c", None)],
        "g string, v string",
    )
    assert rows(stats.mode_by(df, "g", "v")) == [("a", "x"), ("b", "z")]


def test_counts(spark):
    assert [tuple(r) for r in stats.value_counts(reviews(spark), "property_type", 2).collect()] == [
        ("Apartment", 4), ("Loft", 3)
    ]
    assert stats.distinct_count(reviews(spark), "host_id").first()[0] == 7
    assert stats.distinct_count(reviews(spark), "host_id", approx=True).first()[0] == 7
    kept = stats.keep_top_categories(reviews(spark), "property_type", 2)
    assert {r["property_type"] for r in kept.collect()} == {"Apartment", "Loft"}
    assert kept.count() == 7


def test_top_bottom_overlap(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "k string, v double")
    found = rows(stats.top_bottom(df, "k", "v", 2).select("side", "k"))
    assert found == [("bottom", "a"), ("bottom", "c"), ("top", "b"), ("top", "c")]


def test_rating_bands(spark):
    banded = stats.rating_bands(reviews(spark), ["overall_rating"])
    s = frame()["overall_rating"]
    hi, lo = s.quantile(0.75), s.quantile(0.25)
    want = ["High" if v > hi else "Low" if v < lo else "Medium" for v in s]
    found = [r["overall_rating_band"] for r in banded.select("review_id", "overall_rating_band").collect()]
    assert sorted(found) == sorted(want)


def test_tails(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "v double")
    found = rows(stats.quantile_tails(df, "v"))
    s = pd.Series(range(1, 101), dtype=float)
    assert [v for v, t in found if t == "high"] == list(s[s >= s.quantile(0.95)])
    assert [v for v, t in found if t == "low"] == list(s[s <= s.quantile(0.05)])
    same = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert rows(stats.quantile_tails(same, "v")) == [(1.0, "high")] * 2 + [(1.0, "low")] * 2


def test_subset_profile(spark):
    found = stats.subset_profile(
        reviews(spark), F.col("price") == "0", "host_id", ["neighbourhood"], ["overall_rating"]
    )
    assert {(r["metric"], r["key"]): r["value"] for r in found.collect()} == {
        ("row_count", None): 2.0,
        ("distinct_count", "host_id"): 1.0,
        ("mean", "overall_rating"): 80.0,
        ("top_neighbourhood", "Mitte"): 2.0,
    }


def test_areas(spark):
    profile = stats.area_profile(
        reviews(spark), "postal_code", {"rating": "overall_rating"}, {"property": "property_type", "room": "room_type"}
    )
    found = {r["postal_code"]: (r["rating"], r["property"], r["room"]) for r in profile.collect()}
    assert found["01067"] == (60.0, "House", "Private room")
    assert found["13347"] == (99.0, "Loft", "Entire home/apt")
    assert set(found) == {"10115", "01067", "10999", "13347"}
    extremes = rows(stats.area_extremes(profile, "postal_code", "rating", 2).select("side", "rank", "postal_code"))
    assert extremes == [("bottom", 1, "01067"), ("bottom", 2, "10115"), ("top", 1, "13347"), ("top", 2, "10999")]


def test_bins(spark):
    values = [0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    binned = {r["v"]: r["bin"] for r in distribution.equal_width_bins(df, "v", 5).collect()}
    assert binned == dict(zip(values, [1, 1, 1, 2, 3, 4, 5])) | {None: None}
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r["bin"] for r in distribution.equal_width_bins(same, "v", 5).collect()} == {3}
    many = pd.Series(np.random.default_rng(3).uniform(-5, 17, 3000).round(2))
    df = spark.createDataFrame([(float(v),) for v in many], "v double")
    for n in (1, 5, 7, 50):
        want = pd.cut(many, n, labels=False).value_counts() + 0
        found = {r["bin"] - 1: r["count"] for r in distribution.equal_width_bins(df, "v", n).groupBy("bin").count().collect()}
        assert found == {k: v for k, v in want.items() if v}


def test_mean_by_bin_lists_empty_bins(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.1, 3.0), (1.0, 5.0)], "v double, w double")
    assert rows(distribution.mean_by_bin(df, "v", "w", 5)) == [(1, 2.0), (2, None), (3, None), (4, None), (5, 5.0)]


def test_histogram(spark):
    df = spark.createDataFrame([(v, 2.0) for v in (0.0, 0.1, 0.2, 0.5, 1.0)], "v double, c double")
    found = distribution.histogram(df, ["v", "c"], 5).orderBy("column", "bin").collect()
    assert [r["n"] for r in found if r["column"] == "v"] == [2, 1, 1, 0, 1]
    assert [r["n"] for r in found if r["column"] == "c"] == list(np.histogram([2.0] * 5, 5)[0])
    many = np.random.default_rng(4).normal(0, 3, 4000).round(1)
    df = spark.createDataFrame([(float(v),) for v in many], "v double")
    for n in (10, 50):
        counts, edges = np.histogram(many, n)
        found = distribution.histogram(df, "v", n).orderBy("bin").collect()
        assert [r["n"] for r in found] == list(counts)
        assert [r["lower"] for r in found] == pytest.approx(list(edges[:-1]))
        assert found[-1]["upper"] == edges[-1]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_box_stats(spark, monkeypatch, limit):
    monkeypatch.setattr("staylens.runtime.BROADCAST_LIMIT_BYTES", limit)
    draw = np.random.default_rng(5)
    data = [("a", float(v)) for v in draw.standard_t(2, 500)] + [("b", float(v)) for v in draw.normal(9, 1, 80)]
    df = spark.createDataFrame([*data, ("b", None), (None, 1.0)], "k string, v double")
    outside = {r["k"]: r["count"] for r in distribution.box_outliers(df, "k", "v").groupBy("k").count().collect()}
    for r in distribution.box_stats(df, "k", "v").collect():
        v = np.array([x for k, x in data if k == r["k"]])
        q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        found = [r[c] for c in ("n", "q25", "median", "q75", "whisker_low", "whisker_high", "outliers")]
        assert found == pytest.approx([len(v), q1, med, q3, inside.min(), inside.max(), len(v) - len(inside)])
        assert outside.get(r["k"], 0) == r["outliers"]


def test_correlation(spark):
    data = [(1.0, 2.0), (2.0, 1.0), (2.0, None), (5.0, 7.0), (9.0, 8.0), (None, 3.0)]
    df = spark.createDataFrame([(a, b, 4.0) for a, b in data], "a double, b double, k double")
    assert distribution.correlation(df, "a", "b").first()["r"] == pytest.approx(0.911134, abs=1e-6)
    assert distribution.correlation(df, "a", "k").first()["r"] is None
    found = {(r["a"], r["b"]): r["r"] for r in distribution.correlation_matrix(df, ["a", "b", "k"]).collect()}
    want = pd.DataFrame(data, columns=["a", "b"]).assign(k=4.0).corr()
    assert len(found) == 9
    for (x, y), r in found.items():
        assert r == (None if pd.isna(want.loc[x, y]) else pytest.approx(want.loc[x, y]))
    strong = distribution.strong_correlates(df, ["a", "b", "k"], "a", 0.5)
    assert {r["column"] for r in strong.collect()} == {"a", "b"}


def test_wide_correlation_matrix(spark):
    draw = np.random.default_rng(6).normal(size=(200, 11))
    names = [f"c{i}" for i in range(11)]
    draw[:, 1] += draw[:, 0]
    df = spark.createDataFrame(pd.DataFrame(draw, columns=names))
    want = pd.DataFrame(draw, columns=names).corr()
    found = distribution.correlation_matrix(df, names).collect()
    assert len(found) == 121
    assert all(r["r"] == pytest.approx(want.loc[r["a"], r["b"]]) for r in found)


def test_results_do_not_depend_on_layout(spark):
    df = spark.range(5000).selectExpr("id", "cast(hash(id) % 97 as double) v", "concat('g', id % 7) g")
    for build in (
        lambda x: distribution.box_stats(x, "g", "v"),
        lambda x: distribution.histogram(x, "v", 10),
        lambda x: stats.mode_by(x, "g", "v"),
        lambda x: distribution.scatter_sample(x, "id", ["v"], 20),
    ):
        assert rows(build(df)) == rows(build(df.repartition(7, "v")))
