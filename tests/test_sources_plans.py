import csv

import pytest
from pyspark.sql import functions as F
from conftest import rows
from data import REVIEWS, lexicon

from staylens.operators.models import tree
from staylens.plans.rating_model import review_features, train_rating_model
from staylens.plans.explore import area_report, clean_reviews, explore
from staylens.sources import reviews as source

COLUMNS = [
    "Review ID", "Listing ID", "Host ID", "neighbourhood", "Postal Code", "Property Type", "Room Type",
    "Is Superhost", "Host Response Rate", "Price", "Comments", "Overall Rating", "Value Rating",
]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    """A CSV with quoted line breaks, doubled quotes and columns in an order of its own."""
    file = tmp_path_factory.mktemp("csv") / "reviews.csv"
    extra = ["Accuracy Rating", "Cleanliness Rating", "Checkin Rating", "Communication Rating", "Location Rating"]
    with open(file, "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(
            [*reversed(COLUMNS), *extra, "Host Response Time", "Is Exact Location", "Host URL",
             "Listing URL", "Country", "Country Code", "Host Since", "Extra"]
        )
        for r in REVIEWS:
            cells = ["" if v is None else v for v in r]
            cells[10] = cells[10] and f'He said "{cells[10]}"\nsecond line'
            writer.writerow(
                [*reversed(cells), 9, 9, 10, 10, 9, "within an hour", "t", "u", "l", "Germany", "DE", "2015-03-01", "x"]
            )
    return str(file)


def test_rows_with_surplus_or_too_few_cells(spark, tmp_path):
    file = tmp_path / "odd.csv"
    file.write_text('id,comment,price\n1,"fine, quoted",5\n2,bad, with comma,7\n3,short\n4,ok,\n')
    kinds = {"id": "long", "price": "double"}
    with pytest.raises(Exception, match="more cells than the header"):
        source.load_reviews(spark, str(file), kinds).count()
    kept = source.load_reviews(spark, str(file), kinds, surplus="quarantine")
    assert rows(kept) == [(1, "fine, quoted", 5.0), (3, "short", None), (4, "ok", None)]
    assert rows(source.malformed_rows(spark, str(file))) == [("short", "3,short"), ("surplus", "2,bad, with comma,7")]


def test_load(spark, path):
    df = source.load_reviews(spark, path)
    types = dict(df.dtypes)
    assert types["Review ID"] == "bigint" and types["Overall Rating"] == "double"
    assert types["Price"] == types["Postal Code"] == types["Extra"] == "string"
    assert types["Host Since"] == "date"
    assert df.count() == len(REVIEWS)
    first = df.where("`Review ID` = 1").first()
    assert first["Comments"] == 'He said "Great place, great host!"\nsecond line'
    assert df.where("`Postal Code` = '01067'").count() == 3
    assert df.where("isnan(`Overall Rating`)").isEmpty()
    assert df.where("`Overall Rating` is null").count() == 2


def test_save_and_reload(spark, path, tmp_path):
    df = source.load_reviews(spark, path)
    for fmt in ("parquet", "csv"):
        target = str(tmp_path / fmt)
        source.save(df, target, fmt)
        again = source.load_reviews(spark, target, fmt=fmt)
        assert rows(again.select(*COLUMNS)) == rows(df.select(*COLUMNS))
        with pytest.raises(Exception):
            source.save(df, target, fmt)
    with pytest.raises(ValueError):
        source.save(df, str(tmp_path / "x"), "orc")


def test_preview(spark, path):
    df = source.load_reviews(spark, path)
    assert [r["Review ID"] for r in source.preview(df, 3, "Review ID").collect()] == [1, 2, 3]
    assert source.preview(df, 4).count() == 4


def test_explore(spark, path):
    df = source.load_reviews(spark, path)
    cleaned = clean_reviews(df)
    assert sorted(r["Review ID"] for r in cleaned.collect()) == [1, 2, 3, 7, 8, 9, 9]
    report = area_report(cleaned, k=1)
    assert rows(report.select("side", "Postal Code", "average_rating", "common_property_type")) == [
        ("bottom", "10115", pytest.approx(272 / 3), "Apartment"),
        ("top", "10999", 94.0, "Hostel"),
    ]
    found = explore(df)
    assert found["by_room_type"].count() == 3
    assert {r["Is Superhost"] for r in found["by_superhost"].collect()} == {"t", "f"}
    assert all(f.count() > 0 for f in found.values())


def test_model_of_a_review_table(spark, path):
    cleaned = clean_reviews(source.load_reviews(spark, path))
    features = review_features(cleaned, lexicon(spark), numbers=["Price"])
    assert features.count() == 7
    codes = {r["Review ID"]: r["neighbourhood_encoded"] for r in features.collect()}
    assert codes == {1: 0, 2: 0, 3: 0, 7: None, 8: None, 9: 1}
    scores = {r["Review ID"]: r["sentiment_score"] for r in features.collect()}
    assert scores[1] == 0.8 and scores[3] == 0.0
    many = features.crossJoin(spark.range(40)).withColumn("Review ID", F.expr("`Review ID` * 1000 + id")).drop("id")
    model = train_rating_model(
        many, "Review ID", "Overall Rating", ["Price", "sentiment_score"], ["Room Type", "Host Response Rate"],
        tree(), [2], [1, 3],
    )
    assert model.sweep.first()["train_accuracy"] > 0.6
