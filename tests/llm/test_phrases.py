"""Repeated passages against a dictionary of all windows."""

import random

import pytest
from pyspark.sql import functions as F

import oracle
from brute import WORDS
from staylens.llm import queries
from staylens.llm.phrases import drop_repeats

NAME = "op11_repeated_phrases"


def brute(rows):
    """{id: (n_words, n_removed, kept text)} of (id, text) rows with distinct ids; a missing id comes first."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for i, text in ordered:
        words = WORDS.findall(text or "")
        gone = set()
        for at in range(len(words) - 19):
            if first.setdefault(tuple(words[at:at + 20]), (i, at)) != (i, at):
                gone.update(range(at, at + 20))
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def corpus():
    r = random.Random(8)
    fresh = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    shared, phrase = [fresh(n) for n in (20, 21, 35, 60, 150)], fresh(8)
    rows = []
    for i in range(160):
        out = fresh(r.randrange(40))
        for _ in range(r.randrange(4)):
            p = r.choice(shared)
            a = r.randrange(len(p) - 18)
            out += p[a : r.randrange(a + 18, len(p) + 1)] + fresh(r.randrange(25))
        # one phrase of eight words in most texts, with another neighbourhood each time
        rows.append((i, " ".join(out + phrase + fresh(15))))
    copy = " ".join(fresh(90))
    rows += [(200 + i, copy) for i in range(25)] + [(300 + i, " ".join(copy.split()[:50] + fresh(5) + copy.split()[50:])) for i in range(10)]
    rows += [(400, "again and " * 60), (401, "x " * 45), (402, "x " * 19), (403, None), (404, ""), (405, " \n\t"), (None, copy), (406, "É " * 30 + "é " * 30)]
    rows += [(407, " ".join(fresh(20_000))), (408, "\x01 \x02 " * 15)]
    rows += [(409, rows[-2][1] + " " + copy)]
    # windows that begin with repeats of another word each and end alike
    tail = " ".join(fresh(30))
    rows += [(410 + i, f"{x} " * 14 + tail) for i, x in enumerate("xyzxyzxq")]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string")
    return made.withColumns({c: F.lit(c) for c in ("id", "row", "at", "unit", "n_words", "spans")}).repartition(6)


@pytest.mark.parametrize("how", [{}, {"unit_phrases": 3, "unit_pieces": 7, "limit": 0}])
def test_against_brute_force(docs, how):
    found = drop_repeats(docs, **how).collect()
    want = brute(ROWS)
    assert len(found) == len(ROWS)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in found} == want
    assert want[None][1] == 0 and want[200][1] == 90 and want[402][1] == 0 and want[401][1] == 44


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text + " end")]
    found = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in found) == [(1, 0, text), (1, 0, text), (2, 30, "end")]


def test_text_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    found = drop_repeats(spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [("a", 0), ("b", 25)]


def test_empty_table(spark):
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string"), digests=True).count() == 0


def test_query_equals_sql(spark, sf_dir):
    assert oracle.compare(spark, oracle.connect(sf_dir), sf_dir, queries.QUERIES[NAME], queries.ORACLES[NAME]) is None
