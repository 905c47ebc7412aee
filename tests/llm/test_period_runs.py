"""Periodic runs against a search over all lags."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from staylens.llm import queries
from staylens.llm.period_runs import find_runs, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every maximal stretch of every lag, kept where no shorter lag holds on it."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            shorter = (d for d in range(1, q) if all(words[k] == words[k - d] for k in range(start + d, start + length)))
            if length >= max(12, 2 * q) and next(shorter, None) is None:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def spliced(r):
    """Words of periodic pieces within periodic pieces."""
    kinds, out = r.choice([1, 2, 3, 6]), []
    while len(out) < 90:
        block = [r.randrange(kinds) for _ in range(r.randrange(1, 14))]
        if r.random() < 0.4:
            block = block * r.randrange(1, 6) + [r.randrange(kinds) for _ in range(r.randrange(3))]
        out += block * r.randrange(1, 7)
        if r.random() < 0.3:
            out = out + out[-r.randrange(1, len(out) + 1):]
    return out


def test_runs_against_brute_force():
    r = random.Random(11)
    for _ in range(1500):
        words = spliced(r) if r.random() < 0.8 else [r.randrange(2) for _ in range(r.randrange(120))]
        assert runs_of(words) == brute(words), words


def test_known_runs():
    assert runs_of(list("a" * 12)) == [(0, 12, 1)] and runs_of(list("a" * 11)) == []
    assert runs_of(list("abcdefg" * 2)) == [(0, 14, 7)]
    # the outer run holds inner ones of another period
    assert runs_of(list(("a" * 12 + "b") * 2)) == [(0, 12, 1), (0, 26, 13), (13, 12, 1)]


def test_long_repeats_stay_cheap():
    assert runs_of(["same"] * 150_000) == [(0, 150_000, 1)]
    line = [f"w{i}" for i in range(700)]
    assert runs_of(["x", *line * 100, "y"]) == [(1, 70_000, 700)]


def expected(doc_id, text, plant):
    words = WORD.findall(text or "")
    if plant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


@pytest.fixture(scope="module")
def odd_docs(tmp_path_factory, spark):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in spliced(r))) for i in range(150)]
    rows += [(200 + i, " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(1, 90)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "é" * 5), (None, "a b " * 9), (7, rows[7][1]), (904, "a b " * 20)]
    folder = str(tmp_path_factory.mktemp("runs"))
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("id", "runs", "start", "n_words")})
    made.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_query_against_brute_force(spark, odd_docs):
    folder, rows = odd_docs
    found = [tuple(r) for r in queries.QUERIES["op13_period_runs"](spark, folder).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(found, key=key) == sorted((expected(i, t, True) for i, t in rows), key=key)


def test_query_on_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [tuple(r) for r in rows if len(r["text"] or "") < 4000]
    found = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_period_runs"](spark, sf_dir).collect()}
    assert len(found) == len(rows)
    assert all(found[i] == expected(i, t, True) for i, t in short)


def test_operator_gives_runs_and_texts(spark):
    rows = [(1, "go " * 12 + "end"), (2, None)]
    found = {r["doc_id"]: r for r in find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in found[1]["runs"]] == [(0, 12, 1)] and found[1]["collapsed"] == "go end"
    assert found[2]["runs"] == [] and found[2]["collapsed"] == "" and found[2]["n_words"] == 0


def test_empty_table(spark):
    assert find_runs(spark.createDataFrame([], "doc_id long, text string"), digests=True).count() == 0
