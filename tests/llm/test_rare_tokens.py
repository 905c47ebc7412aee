"""Pairs by rare tokens: complete, and no more for a passage that many share."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from staylens.llm.components import components
from staylens.llm.near_dedup import near_dedup
from staylens.llm.rare_tokens import rare_pairs


def sets_of(seed, n):
    r = random.Random(seed)
    passage = r.sample(range(10_000, 20_000), 60)
    sets = []
    while len(sets) < n:
        base = set(r.sample(passage, r.randrange(20, 60))) | {r.randrange(1_000) for _ in range(r.randrange(1, 40))}
        sets.append(base)
        for _ in range(r.randrange(3)):
            sets.append(set(x for x in base if r.random() < 0.93) | {r.randrange(1_000) for _ in range(r.randrange(4))})
    return [s for s in sets[:n] if s]


@pytest.mark.parametrize("percent", [75, 60, 90])
def test_no_similar_pair_is_missed(spark, percent):
    sets = sets_of(3, 90)
    rows = [(i, i % 70 if i < 80 else 5, sorted(s)) for i, s in enumerate(sets)]
    made = spark.createDataFrame(rows, "node long, c long, shingles array<long>")
    found = [(r["a"], r["b"]) for r in rare_pairs(made, percent).collect()]
    assert len(found) == len(set(found))
    known = {frozenset(p) for p in found}
    for i, ci, a in rows:
        for j, cj, b in rows[:i]:
            if ci != cj and brute.similar(set(a), set(b), percent):
                assert frozenset((i, j)) in known
    assert not any(rows[i][1] == rows[j][1] for i, j in found)


def test_a_shared_passage_makes_no_pairs(spark):
    def pairs(n):
        rows = [(i, i, [*range(200), *range(1_000 * i + 1_000, 1_000 * i + 1_150)]) for i in range(n)]
        rows += [(n, n, rows[0][2][:-20])]
        return rare_pairs(spark.createDataFrame(rows, "node long, c long, shingles array<long>"), 75).count()

    assert [pairs(200), pairs(400)] == [1, 1]


def test_variants_of_one_text_that_are_not_similar_make_few_pairs(spark):
    """Sets of one size with 35 of 200 tokens of a base replaced each, in some 20: 0.5 to 0.7 alike."""
    r = random.Random(2)
    rows = []
    for i in range(300):
        own = 20 if i % 10 == 5 else 35
        rows.append((i, i, [*r.sample(range(200), 200 - own), *range(1_000 + 100 * i, 1_000 + 100 * i + own)]))
    rows += [(300 + i, 300 + i, [*rows[i][2][:-5], *range(50_000 + 10 * i, 50_005 + 10 * i)]) for i in range(0, 300, 30)]
    found = {frozenset((x["a"], x["b"])) for x in rare_pairs(spark.createDataFrame(rows, "node long, c long, shingles array<long>"), 75).collect()}
    linked = {frozenset((x[0], y[0])) for x in rows for y in rows if x[0] < y[0] and brute.similar(set(x[2]), set(y[2]))}
    assert len(linked) == 10 and linked <= found and len(found) < 2 * len(rows)


def test_components_of_long_paths_and_stars(spark):
    r = random.Random(1)
    order = list(range(150))
    r.shuffle(order)
    edges = [*zip(order, order[1:]), *[(500, 500 + k) for k in range(1, 300)], *[(1_000 + k, 1_001 + k) for k in range(120)]]
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 150)}, **{500 + k: 500 for k in range(1, 300)}, **{1_000 + k: 1_000 for k in range(1, 121)}}


def test_copies_among_texts_that_share_a_passage(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(120))
    rows = [(i, passage + " " + " ".join(word() for _ in range(60))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " " + word()) for i in range(0, 120, 3)]
    found = {x["doc_id"]: x["component_id"] for x in near_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit(1))).collect()}
    assert found == {**{i: i for i in range(120)}, **{200 + i: i for i in range(0, 120, 3)}}
