import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from staylens.operators import quantiles as q
from staylens.runtime import BROADCAST_LIMIT_BYTES

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def one(spark, values, probs=PROBS):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    found = {r["p"]: r["quantile"] for r in q.exact_quantiles(df, ["a"], probs).collect()}
    return [found.get(p) for p in probs]


def test_fixture(spark):
    found = one(spark, [1.0, 2.0, 2.0, 5.0, 9.0, None], [0.05, 0.25, 0.5, 0.75, 0.95])
    assert found == pytest.approx([1.2, 2, 2, 5, 8.2])


def test_missing_only(spark):
    assert one(spark, [None, float("nan")], [0.5]) == [None]


@pytest.mark.parametrize(
    "name,values",
    [
        # clusters far from zero need several rounds: one bucket holds everything
        ("offset", [1.7e15 + i * 0.25 for i in range(4000)]),
        ("offset_and_zero", [0.0] * 500 + [1.7e15 + i for i in range(3000)]),
        ("negative", [-(1.001 ** i) for i in range(3000)]),
        ("tiny", [i * 1e-12 for i in range(3000)]),
        ("wide", [(-1) ** i * 10.0 ** (i % 300) for i in range(3000)]),
        ("hot", [3.0] * 3000 + [3.0 + i * 1e-9 for i in range(1500)]),
    ],
)
def test_narrowing_is_exact(spark, name, values):
    random.Random(1).shuffle(values)
    assert one(spark, values) == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-300)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e9, max_value=1e9), min_size=1, max_size=60))
def test_equals_numpy(spark, values):
    assert one(spark, values) == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-9, abs=1e-9)


def grouped(spark):
    draw = random.Random(7)
    data = []
    for i in range(6000):
        key = "hot" if i % 3 else draw.choice(["a", "b", "c", None])
        data.append((key, draw.lognormvariate(0, 3), float(draw.randint(1, 5))))
    return data, spark.createDataFrame(data, "k string, x double, y double").repartition(5)


def expected(data):
    out = {}
    for k in {r[0] for r in data if r[0]}:
        for i, c in ((1, "x"), (2, "y")):
            for p in (0.25, 0.5, 0.9):
                out[(k, c, p)] = np.quantile([r[i] for r in data if r[0] == k], p)
    return out


@pytest.mark.parametrize("limit", [BROADCAST_LIMIT_BYTES, 0])
def test_groups_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr("staylens.runtime.BROADCAST_LIMIT_BYTES", limit)
    data, df = grouped(spark)
    found = {
        (r["k"], r["column"], r["p"]): r["quantile"]
        for r in q.exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.9], ["k"]).collect()
    }
    want = expected(data)
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())


def test_sketch_is_close(spark):
    data, df = grouped(spark)
    found = q.quantiles(df, ["x"], [0.5], ["k"], accuracy=10_000).collect()
    want = expected(data)
    assert {r["k"] for r in found} == {"hot", "a", "b", "c"}
    for r in found:
        ranked = sorted(v for k, v, _ in data if k == r["k"])
        low, high = ranked[int(len(ranked) * 0.48)], ranked[int(len(ranked) * 0.52)]
        assert low <= r["quantile"] <= high and want


def test_unknown_column(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(ValueError):
        q.exact_quantiles(df, ["b"], [0.5])
    with pytest.raises(ValueError):
        q.exact_quantiles(df, ["a"], [1.5])


def test_group_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(i % 2, i % 3, float(i)) for i in range(50)], "v int, n int, low double")
    found = q.exact_quantiles(df, ["low"], [0.5], ["v", "n"]).collect()
    want = {(v, n): np.median([i for i in range(50) if (i % 2, i % 3) == (v, n)]) for v in (0, 1) for n in (0, 1, 2)}
    assert {(r["v"], r["n"]): r["quantile"] for r in found} == want
