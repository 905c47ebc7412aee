import pandas as pd
import pytest
from conftest import rows
from data import REVIEWS, reviews

from staylens.operators import clean, profile


def frame():
    columns = [
        "review_id", "listing_id", "host_id", "neighbourhood", "postal_code", "property_type",
        "room_type", "is_superhost", "host_response_rate", "price", "comments", "overall_rating", "value_rating",
    ]
    return pd.DataFrame(REVIEWS, columns=columns)


def test_missing(spark):
    pdf = frame()
    found = {r["column"]: r["missing"] for r in profile.missing_summary(reviews(spark)).collect()}
    assert found == pdf.isnull().sum().to_dict()
    order = [r["missing"] for r in profile.missing_summary(reviews(spark)).collect()]
    assert order == sorted(order, reverse=True)
    share = {r["column"]: r["missing_percent"] for r in profile.missing_percent(reviews(spark)).collect()}
    want = (pdf.isnull().mean() * 100)
    assert share == pytest.approx(want[want > 0].to_dict())
    info = {r["column"]: (r["non_null"], r["dtype"]) for r in profile.column_info(reviews(spark)).collect()}
    assert info["overall_rating"] == (10, "double") and info["comments"] == (11, "string")


def test_empty_table(spark):
    none = reviews(spark).limit(0)
    assert {r["missing"] for r in profile.missing_summary(none).collect()} == {0}
    assert rows(profile.missing_percent(none)) == []
    assert rows(profile.duplicate_count(none)) == [(0,)]
    assert rows(profile.describe(none, ["overall_rating"])) == []


def test_duplicates(spark):
    assert rows(profile.duplicate_count(reviews(spark))) == [(int(frame().duplicated().sum()),)] == [(1,)]
    assert rows(profile.duplicate_count(reviews(spark), ["room_type"])) == [(8,)]
    df = reviews(spark)
    found = profile.dedupe(df, ["listing_id"], ["review_id"])
    assert found.count() == 7 and found.columns == df.columns
    again = profile.dedupe(df.repartition(7), ["listing_id"], ["review_id"])
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))
    assert rows(profile.row_count(reviews(spark))) == [(12,)]


def test_describe_equals_pandas(spark):
    pdf = frame()
    found = profile.describe(reviews(spark), ["overall_rating", "value_rating"]).collect()
    for r in found:
        want = pdf[r["column"]].describe()
        assert [r[c] for c in ("count", "mean", "std", "min", "q25", "median", "q75", "max")] == pytest.approx(list(want))


def test_describe_by_equals_pandas(spark):
    want = frame().groupby("room_type")["overall_rating"].describe()
    found = profile.describe_by(reviews(spark), "room_type", "overall_rating").collect()
    assert {r["room_type"] for r in found} == set(want.index)
    for r in found:
        ours = [r[c] for c in ("count", "mean", "std", "min", "q25", "median", "q75", "max")]
        theirs = [None if pd.isna(x) else x for x in want.loc[r["room_type"]]]
        assert ours == pytest.approx(theirs)


def test_describe_group_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    found = {r["k"]: (r["count"], r["std"], r["median"]) for r in profile.describe_by(df, "k", "v").collect()}
    assert found == {"a": (0, None, None), "b": (1, None, 1.0)}


def test_categories(spark):
    found = profile.describe_categorical(reviews(spark), "property_type").first()
    want = frame()["property_type"].describe()
    assert (found["count"], found["unique"], found["top"], found["freq"]) == tuple(want)
    ties = spark.createDataFrame([("z",), ("a",), (None,)], "v string")
    assert profile.describe_categorical(ties, "v").first()["top"] == "a"
    counts = rows(profile.category_counts(reviews(spark), ["room_type", "is_superhost"]))
    want = [
        (c, v, int(n)) for c in ("room_type", "is_superhost") for v, n in frame()[c].value_counts().items()
    ]
    assert counts == sorted(want)


def test_cleaning(spark):
    df = reviews(spark)
    numbers = clean.coerce_numeric(df, ["price"])
    kept = clean.filter_min(numbers, "price", 0)
    want = frame()
    want["price"] = pd.to_numeric(want["price"], errors="coerce")
    want = want[want["price"] >= 0]
    assert kept.count() == len(want)
    assert clean.filter_equal(numbers, "price", 0).count() == int((want["price"] == 0).sum())
    assert clean.drop_missing(kept, ["overall_rating"]).count() == len(want.dropna(subset=["overall_rating"]))
    assert clean.drop_missing(kept).count() == len(want.dropna())
    ratios = [r[0] for r in clean.coerce_percent(df, ["host_response_rate"]).orderBy("review_id").select("host_response_rate").collect()]
    assert ratios[:7] == [0.9, 0.9, 1.0, 1.0, 0.05, None, None]


def test_names_are_checked(spark):
    df = reviews(spark)
    with pytest.raises(ValueError):
        clean.drop_columns(df, ["no_such_column"])
    spaced = spark.createDataFrame([(1, 2)], ["Room Type", "Overall Rating"])
    assert clean.normalize_names(spaced).columns == ["room_type", "overall_rating"]
    with pytest.raises(ValueError):
        clean.normalize_names(spark.createDataFrame([(1, 2)], ["A b", "a_b"]))


def test_join_with_suffix(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    right = spark.createDataFrame([(1, "z")], "k int, v string")
    joined = clean.join_with_suffix(left, right, ["k"])
    assert joined.columns == ["k", "v_left", "v_right"]
    assert rows(joined) == [(1, "x", "z"), (2, "y", None)]
