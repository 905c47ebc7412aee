import random

import pytest
from conftest import rows
from data import reviews
from pyspark.sql import functions as F

from staylens.operators import evaluate, features

BOTH = pytest.mark.parametrize("limit", [1 << 26, 0])


def test_one_hot_is_in_its_own_row(spark):
    df = reviews(spark).where("review_id > 2")
    encoded, model = features.one_hot(df, ["room_type", "host_response_rate"])
    names = [r["level"] for r in model.levels("room_type").orderBy("slot").collect()]
    assert names == ["Entire home/apt", "Private room", "Shared room", None, None]
    for r in encoded.collect():
        vector = r["room_type_vec"].toArray()
        assert len(vector) == 5 and vector.sum() == 1 and names[int(vector.argmax())] == r["room_type"]
    new = model.transform(spark.createDataFrame([("Tent", "90%"), (None, None)], "room_type string, host_response_rate string"))
    assert [int(r["room_type_vec"].toArray().argmax()) for r in new.orderBy("room_type").collect()] == [3, 4]
    counts = {(r["column"], r["level"]): r["n"] for r in features.one_hot_counts(df, ["room_type"]).collect()}
    assert counts == {
        ("room_type", "Entire home/apt"): 1, ("room_type", "Private room"): 4,
        ("room_type", "Shared room"): 4, ("room_type", None): 1,
    }


def test_one_hot_of_very_many_levels(spark):
    df = spark.range(120_000).selectExpr("id", "concat('v', id) as v")
    encoded, model = features.one_hot(df, ["v"])
    assert model.slots("v") == 120_002
    assert encoded.where("v = 'v77'").first()["v_vec"].size == 120_002


@pytest.mark.parametrize("share", [0.001, 0.07, 0.125, 0.55])
def test_split_meets_any_share(spark, share):
    n = 200_000
    found = features.hash_split(spark.range(n), "id", test=share).where("split = 'test'").count()
    assert abs(found - n * share) < 5 * (n * share * (1 - share)) ** 0.5


@BOTH
def test_label_encode(spark, monkeypatch, limit):
    monkeypatch.setattr("staylens.runtime.BROADCAST_LIMIT_BYTES", limit)
    draw = random.Random(2)
    values = [f"n{draw.randint(0, 400)}" for _ in range(3000)] + ["hot"] * 1500 + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string").repartition(6)
    codes = {v: i for i, v in enumerate(sorted({v for v in values if v}))}
    found = features.label_encode(df, "v", spread=["id"]).collect()
    assert len(found) == len(values)
    assert all(r["v_encoded"] == codes.get(r["v"]) for r in found)


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "b")], "x double, c double, s string")
    assert rows(features.standardize(df)) == [(-1.0, 0.0, "a"), (1.0, 0.0, "b")]
    fitted = features.standardize(spark.createDataFrame([(5.0,), (None,)], "x double"), ["x"], fit_on=df)
    assert rows(fitted) == [(None,), (3.0,)]


def test_split_is_repeatable(spark):
    df = spark.range(20_000)
    train, test = features.split(df, "id")
    assert train.count() + test.count() == 20_000
    assert 0.18 < test.count() / 20_000 < 0.22
    again = features.split(df.repartition(13), "id")[1]
    assert rows(test) == rows(again)
    assert features.hash_split(df, "id", test=0.0).where("split = 'test'").isEmpty()


@BOTH
def test_weights(spark, monkeypatch, limit):
    monkeypatch.setattr("staylens.runtime.BROADCAST_LIMIT_BYTES", limit)
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(100)], "id int, y string")
    assert rows(features.class_weights(df, "y")) == [("a", 75, pytest.approx(100 / 150)), ("b", 25, 2.0)]
    weighted = features.with_class_weights(df, "y", "id")
    assert weighted.count() == 100
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(100)


@pytest.mark.parametrize("salts", [features.FOLD_SALTS, 7])
def test_folds(spark, salts):
    df = spark.range(9000).selectExpr("id", "case when id % 3 = 0 then 'x' when id % 50 = 1 then 'rare' else 'y' end y")
    folded = features.stratified_folds(df, "id", "y", 5, salts=salts)
    assert folded.count() == 9000
    sizes = {}
    for r in folded.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    for counts in sizes.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= salts
    assert rows(folded) == rows(features.stratified_folds(df.repartition(9), "id", "y", 5, salts=salts))


LABELS = [("High", "High")] * 3 + [("High", "Low")] + [("Low", "Low")] * 2 + [("Medium", "Low")] * 4


def test_report(spark):
    df = spark.createDataFrame(LABELS, "y string, p string")
    assert evaluate.accuracy(df, "y", "p").first()[0] == 0.5
    matrix = rows(evaluate.confusion_matrix(df, "y", "p"))
    assert matrix == [
        ("High", "High", 3), ("High", "Low", 1), ("High", "Medium", 0),
        ("Low", "High", 0), ("Low", "Low", 2), ("Low", "Medium", 0),
        ("Medium", "High", 0), ("Medium", "Low", 4), ("Medium", "Medium", 0),
    ]
    found = {r["class"]: tuple(r)[1:] for r in evaluate.classification_report(df, "y", "p").collect()}
    high, low = (1.0, 0.75, 6 / 7, 4), (2 / 7, 1.0, 4 / 9, 2)
    assert found["High"] == pytest.approx(high) and found["Low"] == pytest.approx(low)
    assert found["Medium"] == (0.0, 0.0, 0.0, 4)
    assert found["accuracy"] == (None, None, 0.5, 10)
    assert found["macro avg"] == pytest.approx(((9 / 7) / 3, 1.75 / 3, (6 / 7 + 4 / 9) / 3, 10))
    assert found["weighted avg"] == pytest.approx(((4 + 4 / 7) / 10, 0.5, (24 / 7 + 8 / 9) / 10, 10))
