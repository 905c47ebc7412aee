import re

from conftest import rows
from pyspark.sql import functions as F

from staylens.functions.scalars import grouping_key, percent_to_ratio, quantile_band, sentiment_band, to_number
from staylens.functions.text import ENGLISH_STOP_WORDS, letter_tokens, remove_stopwords, strip_non_letters, tokenize


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")


def column_of(df, expression):
    return [r[0] for r in df.orderBy("id").select(expression).collect()]


def test_prices(spark):
    df = texts(spark, ["10", "10d", "$1,200", " 7 ", "NaN", "1e3", "", None, "-2.5", ".5", "inf"])
    assert column_of(df, to_number("v")) == [
        10.0, None, None, 7.0, None, 1000.0, None, None, -2.5, 0.5, float("inf")
    ]


def test_percents(spark):
    df = texts(spark, ["90%", "100%", "5", "n/a", None])
    assert column_of(df, percent_to_ratio("v")) == [0.9, 1.0, 0.05, None, None]


def test_bands(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 9.0), (3, None), (4, float("nan"))], "id int, v double")
    assert column_of(df, quantile_band("v", 2.0, 5.0)) == ["Low", "Medium", "High", "Medium", "Medium"]
    scores = spark.createDataFrame([(0, 0.11), (1, 0.1), (2, -0.1), (3, -0.11)], "id int, v double")
    assert column_of(scores, sentiment_band("v")) == ["Positive", "Neutral", "Neutral", "Negative"]


def test_letters(spark):
    many = "a!" * 300 + " Z9"
    values = ["Schöne Wohnung, Nr. 5! ok", None, "", "a b\tc", many]
    df = texts(spark, values)
    expected = [re.sub(r"[^a-zA-Z\s]", "", v or "") for v in values]
    assert expected[0] == "Schne Wohnung Nr  ok"
    assert column_of(df, strip_non_letters("v")) == expected
    limited = [re.sub(r"[^a-zA-Z\s]", "", v or "", count=258) for v in values]
    assert limited[4] != expected[4]
    assert column_of(df, strip_non_letters("v", 258)) == limited
    assert column_of(df, letter_tokens("v")) == [(e.lower()).split() for e in expected]


def test_stop_words_keep_order_and_repeats(spark):
    df = texts(spark, ["the host was the best best host", "the", None])
    assert column_of(df, remove_stopwords(tokenize("v"))) == [["host", "best", "best", "host"], [], []]
    assert len(ENGLISH_STOP_WORDS) == len(set(ENGLISH_STOP_WORDS)) == 179


def test_grouping_key_tells_texts_apart(spark):
    digest = "#" + "0" * 64
    df = texts(spark, ["x" * 200, "x" * 201, digest, "short", None])
    keys = column_of(df, grouping_key(F.col("v"), True, False))
    assert len(set(keys)) == 5 and max(len(k) for k in keys if k) == 65
    assert keys[3:] == ["short", None]
    assert rows(df.limit(0)) == []
