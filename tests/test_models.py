import pytest
from pyspark.sql import functions as F

from staylens.operators import features, models
from staylens.plans.rating_model import train_rating_model


@pytest.fixture(scope="module")
def table(spark):
    """Rating depends on price and room: separable by shallow trees."""
    return spark.range(1200).selectExpr(
        "id", "cast(id % 100 as double) price", "cast(hash(id) % 50 as double) noise",
        "case when id % 2 = 0 then 'private' else 'shared' end room",
        "cast(id % 100 as double) + case when id % 2 = 0 then 30 else 0 end rating",
    )


@pytest.fixture(scope="module")
def data(table):
    from staylens.operators.stats import rating_bands

    banded = rating_bands(table, ["rating"], suffix="_class")
    prepared = models.prepare(banded, "id", "rating_class", ["price", "noise"], ["room"])
    yield prepared
    prepared.unpersist()


def test_prepare(data):
    assert data.classes == ["High", "Low", "Medium"]
    assert data.train.count() + data.test.count() == 1200
    assert data.train.columns == ["label_index", "id", "features", "weight"]
    assert data.train.first()["features"].size == 2 + 4


def test_every_requested_depth_has_a_row(data):
    assert models.fitted_depths([29, 30, 31, 31, 40]) == [(29, 29), (30, 30), (31, 30), (40, 30)]
    found = models.depth_sweep(data, models.tree(), [2, 31, 40]).collect()
    assert [(r["depth"], r["fitted_depth"]) for r in found] == [(2, 2), (31, 30), (40, 30)]
    assert found[1]["test_accuracy"] == found[2]["test_accuracy"]


def test_class_of_test_rows_only_counts_as_wrong(spark):
    made = features.hash_split(spark.range(1000), "id").selectExpr(
        "id", "cast(id % 2 as double) as x",
        "case when split = 'test' and id % 3 = 0 then 'new' when id % 2 = 0 then 'a' else 'b' end as y",
    )
    data = models.prepare(made, "id", "y", ["x"])
    model = models.fit_depth(data, models.tree(), 3)
    predicted = models.predict(data, model)
    n, new = predicted.count(), predicted.where("label = 'new'").count()
    assert n == made.where("y = 'new'").count() + predicted.where("label <> 'new'").count() and new > 0
    assert predicted.where("label = predicted").count() == n - new
    data.unpersist()


@pytest.mark.parametrize("family", [models.forest(num_trees=8), models.tree(), models.boosted(rounds=4)], ids=lambda f: f.name)
def test_sweep_learns(data, family):
    majority = data.train.groupBy("label_index").count().agg(F.max("count")).first()[0] / data.train.count()
    found = models.depth_sweep(data, family, [4], parallelism=2).first()
    assert found["model"] == family.name and found["depth"] == 4
    assert found["train_accuracy"] > majority + 0.1 and found["test_accuracy"] > majority
    again = models.depth_sweep(data, family, [4]).first()
    assert again["train_accuracy"] == found["train_accuracy"]


def test_one_vs_rest_matches_its_margins(data):
    model = models.fit_depth(data, models.boosted(rounds=2), 3)
    predicted = model.transform(data.test)
    assert predicted.columns == [*data.test.columns, "prediction"]
    assert predicted.where(F.col("prediction").isNull()).isEmpty()
    assert predicted.select("prediction").distinct().count() > 1


def test_whole_plan(table):
    result = train_rating_model(
        table, "id", "rating", ["price", "noise"], ["room"], models.tree(), [2, 5], [1, 5], fit_scope="all"
    )
    assert result.search.best_depth == 5
    scores = {r["depth"]: r["mean_accuracy"] for r in result.search.scores.collect()}
    assert scores[5] > scores[1]
    assert result.sweep.count() == 2
    total = result.confusion.agg(F.sum("n")).first()[0]
    assert total == result.search.predictions.count()
    assert {r["class"] for r in result.report.collect()} >= {"High", "Low", "Medium", "accuracy"}


@pytest.fixture(scope="module")
def repeated(spark):
    """Few distinct rows, many of each, and a class that the features do not decide."""
    made = spark.range(3000).selectExpr(
        "id", "cast(id % 5 as double) x", "cast(id % 3 as double) z", "case when hash(id) % 7 = 0 then 'odd' when id % 5 < 2 then 'low' else 'high' end y"
    )
    return models.prepare(made, "id", "y", ["x", "z"])


@pytest.mark.parametrize("family", [models.tree(), models.tree(balanced=False), models.boosted(rounds=3)], ids=["tree", "plain", "boosted"])
def test_groups_give_the_model_of_their_rows(repeated, family):
    assert family.groups and not models.forest().groups and not models.tree(min_instances=5).groups
    few = models.grouped(repeated.train)
    assert few.count() < 50 and few.agg(F.sum("_copies")).first()[0] == repeated.train.count()
    rows = family.fit(repeated.train, 3, 3).transform(repeated.test).select("id", "prediction")
    found = models.fit_depth(repeated, family, 3).transform(repeated.test).select("id", "prediction")
    assert sorted(found.collect()) == sorted(rows.collect())
    sweep = models.depth_sweep(repeated, family, [3]).first()
    right = rows.join(repeated.test, "id").where("prediction = label_index").count()
    assert sweep["test_accuracy"] == pytest.approx(right / repeated.test.count())


@pytest.mark.parametrize("family", [models.tree(), models.forest(num_trees=3)], ids=lambda f: f.name)
def test_depths_that_stop_growing_share_a_fit(repeated, family):
    asked = []

    def fit(rows, depth, classes):
        asked.append(depth)
        return family.fit(rows, depth, classes)

    counted = models.TreeFamily(family.name, fit, family.balanced, family.groups)
    depths = [1, 2, 9, 10, 11, 12, 13, 14, 15]
    sweep = models.depth_sweep(repeated, counted, depths).collect()
    assert [r["depth"] for r in sweep] == depths and len(set(asked)) == len(asked) < len(depths)
    one_by_one = [models.depth_sweep(repeated, family, [d]).first() for d in (1, 2, 12)]
    assert [sweep[i]["test_accuracy"] for i in (0, 1, 5)] == [r["test_accuracy"] for r in one_by_one]
    asked.clear()
    scores = models.cv_scores(repeated, counted, [9, 10, 11, 12], folds=3).collect()
    assert sorted(asked) == [9] * 3 + [12] * 3 and len({r["mean_accuracy"] for r in scores}) == 1
    assert models.cv_scores(repeated, family, [10], folds=3).first()["mean_accuracy"] == scores[1]["mean_accuracy"]


def test_counted_cells_stand_for_the_rows(repeated):
    """What is fitted, scaled and weighted comes from counts of equal rows, made in one pass."""
    assert repeated.cells.agg(F.sum("_copies")).first()[0] == 3000 and repeated.cells.count() < 100
    made = models._groups(repeated, repeated.cells.where("_split = 'train'"), "weight").collect()
    want = models.grouped(repeated.train, "weight").collect()
    key = lambda r: (r["label_index"], str(r["features"]))
    assert [(key(r), r["weight"], r["_copies"]) for r in sorted(made, key=key)] == [(key(r), r["weight"], r["_copies"]) for r in sorted(want, key=key)]
    scales = features.standardize(repeated.rows, ["x", "z"], fit_on=repeated.rows.where("_split = 'train'"))
    one = scales.orderBy("id").first(), repeated.encode(repeated.rows).orderBy("id").first()
    assert list(one[1]["features"]) == pytest.approx([one[0]["x"], one[0]["z"]])


def test_forest_draws_rows_of_groups(repeated, monkeypatch):
    monkeypatch.setattr(models, "DRAWN_ROWS", 1_000)
    groups = models._to_fit(repeated, models.forest())
    assert groups.count() < 50 and not models._repeat(models.grouped(repeated.train).withColumn("_copies", F.lit(1)))
    drawn = models._drawn(groups, 400, 7).selectExpr("_copies", "aggregate(_drawn, 0L, (s, x) -> s + x) / 400 as mean", "array_distinct(_drawn) as d").collect()
    assert all(abs(r["mean"] - r["_copies"]) < 5 * (r["_copies"] / 400) ** 0.5 for r in drawn) and max(len(r["d"]) for r in drawn) > 20
    model = models.fit_depth(repeated, models.forest(num_trees=6), 4)
    assert isinstance(model, models.DrawnForest) and len(model.models) == 6
    plain = models.forest(num_trees=6).fit(repeated.train, 4, 3)
    shares = [m.transform(repeated.test).withColumn("right", (F.col("prediction") == F.col("label_index")).cast("int")).agg(F.avg("right")).first()[0] for m in (model, plain)]
    assert shares[0] == pytest.approx(shares[1], abs=0.1)
