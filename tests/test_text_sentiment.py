import pytest
from conftest import rows
from data import REVIEWS, lexicon, reviews

from staylens.operators import sentiment as mood
from staylens.operators import text as words
from staylens.plans.comments import comment_report, score_comments

BOTH = pytest.mark.parametrize("limit", [1 << 26, 0])


def brute(comment, table, multipliers=None):
    tokens = [t for t in "".join(c for c in (comment or "").lower() if c.isalpha() or c.isspace()).split()]
    tokens = [t for t in tokens if t not in words.ENGLISH_STOP_WORDS]
    found = []
    for i, t in enumerate(tokens):
        if t in table:
            m = (multipliers or {}).get(tokens[i - 1], 1.0) if i else 1.0
            found.append(max(-1.0, min(1.0, table[t] * m)))
    return sum(found) / len(found) if found else 0.0


@BOTH
def test_scores(spark, monkeypatch, limit):
    monkeypatch.setattr("staylens.runtime.BROADCAST_LIMIT_BYTES", limit)
    table = dict([(r.token, r.polarity) for r in lexicon(spark).collect()])
    unique = reviews(spark).dropDuplicates(["review_id"])
    scored = score_comments(unique, "review_id", "comments", lexicon(spark), ["room_type"])
    want = {r[0]: brute(r[10], table) for r in REVIEWS}
    assert {r["review_id"]: r["sentiment_score"] for r in scored.collect()} == pytest.approx(want)
    assert want[3] == want[4] == 0.0 and want[7] == pytest.approx(0.0)
    assert scored.columns == ["review_id", "room_type", "sentiment_score", "sentiment_category"]


@BOTH
def test_modifiers(spark, monkeypatch, limit):
    monkeypatch.setattr("staylens.runtime.BROADCAST_LIMIT_BYTES", limit)
    data = [(1, "truly great"), (2, "hardly nice hardly bad"), (3, "great great"), (4, "truly truly")]
    df = spark.createDataFrame(data, "id long, t string")
    multipliers = {"truly": 1.5, "hardly": -0.5}
    table = spark.createDataFrame(list(multipliers.items()), "token string, multiplier double")
    polarity = dict([(r.token, r.polarity) for r in lexicon(spark).collect()])
    found = dict(rows(mood.sentiment_score(df, "id", "t", lexicon(spark), table)))
    assert found == pytest.approx({k: brute(v, polarity, multipliers) for k, v in data})
    assert found[1] == 1.0


def test_several_senses_are_averaged(spark):
    df = spark.createDataFrame([(1, "fine")], "id long, t string")
    senses = spark.createDataFrame([("fine", 0.2), ("fine", 0.6)], "token string, polarity double")
    assert rows(mood.sentiment_score(df, "id", "t", senses)) == [(1, 0.4)]


def test_own_scorer(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    found = mood.sentiment_score(df, "id", "t", scorer=lambda texts: texts.str.len() / 10.0)
    assert rows(found) == [(1, 0.3), (2, 0.0)]


@BOTH
def test_lemmas(spark, monkeypatch, limit):
    monkeypatch.setattr("staylens.runtime.BROADCAST_LIMIT_BYTES", limit)
    df = spark.createDataFrame([(1, "The Beds, beds and cities!"), (2, None), (3, "plain")], "id long, t string")
    table = spark.createDataFrame([("beds", "bed"), ("cities", "city")], "token string, lemma string")
    found = words.normalize_text(df, "t", lemmas=table, key="id")
    assert rows(found) == [(1, "bed bed city"), (2, ""), (3, "plain")]


def test_noun_lemmas(spark):
    tokens = [("beds",), ("cities",), ("glasses",), ("bus",), ("women",), ("feet",), ("wolves",), (None,), ("churches",)]
    nouns = [("bed",), ("city",), ("glass",), ("bus",), ("woman",), ("foot",), ("wolf",), ("church",)]
    tokens, nouns = (spark.createDataFrame(x, "token string") for x in (tokens, nouns))
    irregular = spark.createDataFrame([("feet", "foot"), ("geese", "goose")], "token string, lemma string")
    assert dict(rows(words.noun_lemmas(tokens, nouns, irregular))) == {
        "beds": "bed", "cities": "city", "glasses": "glass", "women": "woman", "feet": "foot",
        "wolves": "wolf", "churches": "church",
    }


def test_token_counts(spark):
    df = spark.createDataFrame([("One, two two",), (None,), ("two!",)], "t string")
    assert rows(words.token_counts(df, "t")) == [("one", 1), ("two", 3)]


def test_report(spark):
    unique = reviews(spark).dropDuplicates(["review_id"])
    report = comment_report(unique, "review_id", "comments", lexicon(spark), ["room_type", "is_superhost"], "overall_rating")
    assert report["summary"].first()["median"] is not None
    assert sum(r["n"] for r in report["bands"].collect()) == 11
    assert sum(r["n"] for r in report["histogram"].collect()) == 11
    assert {r["room_type"] for r in report["by_room_type"].collect()} == {"Entire home/apt", "Private room", "Shared room"}
    assert -1 <= report["correlation"].first()["r"] <= 1
    assert {r["tail"] for r in report["tails"].collect()} == {"high", "low"}
    whole = mood.add_sentiment(unique, "review_id", "comments", lexicon(spark))
    assert whole.count() == 11 and "sentiment_category" in whole.columns
