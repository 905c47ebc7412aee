"""Joins with hot keys, bucketed tables, and the plans with all their options."""

import uuid

import pytest
from conftest import rows
from data import NAN, lexicon, reviews
from pyspark.sql import functions as F

from staylens import runtime
from staylens.operators import profile, stats
from staylens.operators import text as words
from staylens.plans import explore as plan
from staylens.plans.comments import comment_report
from staylens.sources.reviews import save_bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, another tenth in a second one, some without a key."""
    k = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "warm").when(F.col("id") % 50 == 2, None)
    return spark.range(30_000).select("id", k.otherwise(F.concat(F.lit("k"), F.col("id") % 4000)).alias("a key"))


def test_sketch_finds_the_hot_keys_only(skewed):
    hot = {r["_hot_key"]: r["_hot_copies"] for r in runtime.hot_keys(skewed, ["a key"], 16).collect()}
    names = {r["h"]: r["a key"] for r in skewed.select("a key", F.xxhash64("a key").alias("h")).distinct().collect()}
    assert {names[h]: n for h, n in hot.items()} == {"hot": 6, "warm": 2}
    assert runtime.hot_keys(skewed.where("id < 20"), ["id"], 4) is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_shared_by_tasks(spark, skewed, how):
    side = skewed.select("a key").where("`a key` not like 'k1%'").distinct()
    side = side if how in ("left_semi", "left_anti") else side.withColumn("w", F.length("a key"))
    measured = runtime.measure(side, limit=0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = runtime.join_sized(skewed, measured, ["a key"], how, ["id"], parts=16)
        sizes = joined.groupBy(F.spark_partition_id(), "a key").count()
        assert rows(joined) == rows(skewed.join(side, "a key", how).select(*joined.columns))
        if how == "inner":
            # with as many partitions as shares, no task gets more than a few shares of the hot key
            spark.conf.set("spark.sql.shuffle.partitions", "64")
            joined = runtime.join_sized(skewed, measured, ["a key"], how, ["id"], parts=16)
            sizes = joined.where("`a key` = 'hot'").groupBy(F.spark_partition_id().alias("p")).count()
            assert sizes.count() >= 4 and sizes.agg(F.max("count")).first()[0] <= 6_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_categories_past_the_broadcast_limit(spark, skewed, monkeypatch):
    want = {"hot", "warm"}
    for limit in (runtime.BROADCAST_LIMIT_BYTES, 0):
        monkeypatch.setattr(runtime, "BROADCAST_LIMIT_BYTES", limit)
        kept = stats.keep_top_categories(skewed, "a key", 2)
        assert {r["a key"] for r in kept.select("a key").distinct().collect()} == want and kept.count() == 12_000


def test_bucketed_table_needs_no_exchange(spark, tmp_path, sf_dir):
    name = f"lines_{uuid.uuid4().hex}"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        saved = save_bucketed(lines, name, "l_suppkey", 4, str(tmp_path / "lines"))
        for found in (
            stats.mean_by(saved, "l_suppkey", "l_tax"),
            stats.mode_by(saved, "l_suppkey", "l_returnflag"),
            stats.area_profile(saved, "l_suppkey", {"a": "l_tax"}, {"b": "l_returnflag", "c": "l_linestatus"}, by_parts=True),
        ):
            assert "Exchange" not in plan_of(found)
        assert dict(rows(stats.mean_by(saved, "l_suppkey", "l_tax"))) == pytest.approx(dict(rows(stats.mean_by(lines, "l_suppkey", "l_tax"))))
        assert rows(profile.describe_by(saved, "l_suppkey", "l_quantity").select("l_suppkey", "median")) == rows(
            profile.describe_by(lines, "l_suppkey", "l_quantity").select("l_suppkey", "median")
        )
        with pytest.raises(Exception):
            save_bucketed(lines, name, "l_suppkey", 4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table if exists {name}")


COLUMNS = plan.ReviewColumns(
    price="price", rating="overall_rating", ratings=("overall_rating", "value_rating"), numbers=("price", "host_id"),
    host="host_id", neighbourhood="neighbourhood", area="postal_code", property_type="property_type", room_type="room_type",
    superhost="is_superhost", response_time="room_type", response_rate="host_response_rate", unused=("listing_id",), required=("room_type",),
)


def test_exploration_of_a_small_table(spark):
    found = plan.explore(reviews(spark), COLUMNS, k=1)
    assert found["duplicates"].first()["duplicates"] == 1
    # prices below zero and those that are no numbers are gone
    assert found["price"].first()["count"] == 9
    free = {(r["metric"], r["key"]): r["value"] for r in found["zero_price"].collect()}
    assert free["row_count", None] == 2 and free["distinct_count", "host_id"] == 1 and free["mean", "value_rating"] == 8.0
    assert free["top_property_type", "Loft"] == 2
    cleaned = {r["column"]: r["count"] for r in found["ratings"].collect()}
    assert cleaned == {"overall_rating": 7, "value_rating": 7}
    assert {r["band"] for r in found["rating_bands"].collect()} == {"High", "Medium", "Low"}
    assert {r["column"] for r in found["strong_correlates"].collect()} == {"overall_rating", "value_rating"}
    assert found["strong_pairs"].agg(F.sum("n")).first()[0] == 7
    assert {r["room_type"]: r["n"] for r in found["room_type_boxes"].collect()} == {"Entire home/apt": 2, "Private room": 2, "Shared room": 3}
    assert found["property_type_boxes"].count() == found["by_property_type"].count()
    assert [r["side"] for r in found["postal_codes"].orderBy("side").collect()] == ["bottom", "top"]
    assert found["by_response_rate"].count() == 5
    assert "FileScan" not in plan_of(found["correlations"]) and "LocalTableScan" not in plan_of(found["areas"])
    assert all(f.count() > 0 for f in found.values())


def test_exploration_of_a_table_that_lacks_a_column(spark):
    with pytest.raises(Exception):
        plan.explore(reviews(spark).drop("value_rating"), COLUMNS)


def test_comment_report_with_lemmas_modifiers_and_stop_words(spark):
    df = spark.createDataFrame([(1, "very greats places", "a", 5.0), (2, "the bad", "b", 1.0), (3, None, "b", NAN)], "id long, c string, g string, r double")
    lemmas = spark.createDataFrame([("greats", "great")], "token string, lemma string")
    modifiers = spark.createDataFrame([("very", 1.2)], "token string, multiplier double")
    scores = lambda **how: {r["id"]: r["sentiment_score"] for r in comment_report(df, "id", "c", lexicon(spark), ["g"], "r", **how)["scores"].collect()}
    assert scores() == {1: 0.0, 2: -0.7, 3: 0.0}
    assert scores(lemmas=lemmas) == {1: 0.8, 2: -0.7, 3: 0.0}
    # the modifier acts only while it is no stop word
    assert scores(lemmas=lemmas, modifiers=modifiers, stop_words=["the"])[1] == pytest.approx(0.96)
    assert scores(stop_words=["bad"])[2] == 0.0


def test_irregular_forms_replace_the_endings(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "token string")
    pairs = spark.createDataFrame([("buses", "bus"), ("geese", "goose"), ("axes", "axis"), ("none", None)], "token string, lemma string")
    nouns = one("buse", "bus", "goose", "axe", "axis", "cat")
    found = dict(rows(words.noun_lemmas(one("buses", "geese", "axes", "cats", "none"), nouns, pairs)))
    assert found == {"buses": "bus", "geese": "goose", "axes": "axis", "cats": "cat"}
    assert dict(rows(words.noun_lemmas(one("axes"), nouns)))["axes"] == "axe"




def test_exploration_reads_columns_not_rows(spark):
    """Each result reads the columns it needs of the stored rows, as a checkpoint of whole rows would not let it."""
    found = plan.explore(reviews(spark), COLUMNS, k=1)["by_superhost"]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in text and "ExistingRDD" not in text and COLUMNS.price not in text.partition("ReadSchema")[2]
