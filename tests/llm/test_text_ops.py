"""The operators that find repeats and passages: SQL, brute force, and hard rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import oracle
from staylens.llm import line_dedup, queries
from staylens.llm.components import components
from staylens.llm.decontaminate import decontaminate
from staylens.llm.exact_dedup import exact_dedup
from staylens.llm.line_dedup import dedup_lines
from staylens.llm.near_dedup import near_dedup

LONG = " ".join(f"w{i}" for i in range(30_000))


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def edited(text, seed, every):
    r = random.Random(seed)
    out = text.split(" ")
    for k in range(r.randrange(every), len(out), every):
        out[k] = f"x{seed}y{k}"
    return " ".join(out)


BASE = " ".join(words(1, 120))
CHAIN = [edited(BASE, 100 + k, 60) for k in range(12)]
DOCS = [
    (1, BASE), (2, BASE.upper()), (3, BASE + "  "), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (8, "One  TWO"), (9, "two one"),
    (10, LONG), (11, LONG + " end"), (12, "É one two three four"), (13, "é one two three four"),
    *[(20 + k, t) for k, t in enumerate(CHAIN)],
    *[(40 + k, edited(CHAIN[k], 500 + k, 50)) for k in range(12)],
    *[(60 + k, " ".join(words(900 + k, 80))) for k in range(10)],
]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with those that operators make."""
    made = spark.createDataFrame(DOCS, "doc_id long, text string")
    return made.withColumns({c: F.lit(c) for c in ("id", "kept", "node", "n", "_r1x", "key", "line", "at", "tokens", "component_id")}).repartition(5)


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, sf_dir, con):
    assert oracle.compare(spark, con, sf_dir, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_components_against_brute_force(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 3), (7, None)]
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    both = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    nodes = {n for e in edges for n in e if n is not None}
    want = brute.groups(nodes, lambda a, b: (a, b) in both)
    assert {n: found.get(n, n) for n in nodes} == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [None, 0])
def test_near_dedup_against_brute_force(docs, limit):
    found = near_dedup(docs, limit=limit).collect()
    want = brute.near(DOCS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found) and len(found) == len(DOCS)


def test_near_dedup_rows_without_id_and_repeated_rows(spark):
    rows = [(None, BASE), (1, BASE), (1, BASE), (2, BASE), (None, None)]
    found = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found)
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    assert near_dedup(none).count() == exact_dedup(none).count() == dedup_lines(none).count() == decontaminate(none, none).count() == 0


@pytest.mark.parametrize("limit", [None, 0])
def test_exact_dedup_ties_nulls_and_repeats(spark, limit):
    rows = [(3, "a b"), (1, "a  b"), (2, "ab "), (9, None), (8, ""), (5, "zz"), (5, "zz"), (None, "q"), (6, "q"), (7, "x" * 200 + "1"), (4, "x" * 200 + "2"), (0, LONG)]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("count", F.lit(1))
    found = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(made, limit=limit).collect()))
    assert found == [
        (False, 0, 6, 2, False), (True, 0, 0, 1, True), (True, 1, 1, 3, True), (True, 2, 1, 3, False), (True, 3, 1, 3, False), (True, 4, 4, 1, True),
        (True, 5, 5, 2, False), (True, 5, 5, 2, True), (True, 6, 6, 2, True), (True, 7, 7, 1, True), (True, 8, 8, 2, True), (True, 9, 8, 2, False),
    ]


LINES = [
    (1, "Short\nThe first line of this page is here\n\nand another line that stays alone"),
    (2, "the FIRST line  of this page is here\nShort\nunique line number two of the corpus"),
    (3, "\n".join(edited(" ".join(words(7, 60)), k, 55) for k in range(6))),
    (4, "x" * 300 + "\n" + "x" * 150 + "y" * 150 + "\n" + "".join(words(11, 60))),
    (5, "q" + "".join(words(11, 60)) + "\nThe first line of this page is here"),
    (6, None), (7, ""), (8, "\n\n"), (9, LONG[:20_000]), (10, LONG[:20_000] + " more\n" + BASE), (11, edited(BASE, 5, 40)),
]


@pytest.mark.parametrize("limit", [None, 0])
def test_line_dedup_against_brute_force(spark, limit):
    made = spark.createDataFrame(LINES, "doc_id long, text string").withColumns({"id": F.lit("i"), "h1": F.lit(1)})
    found = {r["doc_id"]: r for r in dedup_lines(made, limit=limit).collect()}
    want = brute.lines_left(LINES)
    assert {i: (r["text"] or "") for i, r in found.items()} == want
    assert found[6]["text"] is None and found[2]["first_ids"] == [1] and found[5]["lines_removed"] == 2


def test_line_dedup_looks_at_every_position(spark):
    """Lines whose words are cut elsewhere share most positions, and too few that start at words."""
    long_words = "".join(words(31, 30))[:220]
    parted = " ".join(long_words[i:i + 20] for i in range(0, 220, 20))
    shifted = "z" + parted.replace(" ", "", 1)
    rows = [(1, parted), (2, shifted), (3, "y" * 16), (4, "y" * 40), (5, " ".join(words(77, 30)))]
    every = {i: {t[k:k + 16] for k in range(len(t) - 15)} for i, t in rows}
    at_words = {i: set(brute.SHINGLE.findall(t)) for i, t in rows}
    assert brute.similar(every[1], every[2]) and not brute.similar(at_words[1], at_words[2])
    found = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: parted, 2: "", 3: "y" * 16, 4: "", 5: rows[4][1]}


def test_line_dedup_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.lines_left(rows)


ITEM = " ".join(words(21, 40))
ITEMS = [(1, ITEM), (2, "alpha beta gamma delta epsilon zeta"), (3, "too short"), (4, None), (1, ITEM)]
LEAKY = [
    (1, "before " + ITEM + " after"), (2, "x " * 50 + edited(ITEM, 3, 7)), (3, " ".join(ITEM.split()[:14])), (4, " ".join(ITEM.split()[:9])),
    (5, "Alpha, beta; GAMMA delta epsilon-zeta!"), (6, "too short"), (7, None), (8, ""), (9, LONG + " " + ITEM), (10, BASE), (1, "before " + ITEM + " after"),
]


@pytest.mark.parametrize("limit", [None, 0])
def test_decontaminate_against_brute_force(spark, limit):
    made = spark.createDataFrame(LEAKY, "doc_id long, text string").withColumns({"item": F.lit("i"), "seed": F.lit(1), "tokens": F.lit(1)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = decontaminate(made, items, limit=limit).collect()
    assert len(found) == len(LEAKY)
    assert {(r["doc_id"], i) for r in found for i in r["item_ids"]} == brute.leaks(LEAKY, ITEMS)
    assert {r["doc_id"] for r in found if r["contaminated"]} == {1, 2, 3, 5, 9}


@pytest.mark.parametrize("every", [5, 10])
def test_decontaminate_finds_items_of_every_length(spark, every):
    r = random.Random(every)
    items, docs = [], []
    for k in range(160):
        item = words(5_000 + k, 5 + k % 20)
        items.append((k, " ".join(item)))
        text = [w if r.randrange(every) else f"z{k}q{i}" for i, w in enumerate(item)]
        docs.append((k, " ".join([*words(9_000 + k, 6), *text, *words(8_000 + k, 6)])))
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], i) for x in decontaminate(*made).collect() for i in x["item_ids"]}
    want = brute.leaks(docs, items)
    assert found <= want and {p for p in want if p[0] % 20 < 11} <= found
    assert len(found) >= 0.9 * len(want) > 50


def test_clashing_columns(spark):
    names = ("lines_removed", "_gone", "_first", "first_ids", "_items", "_most", "_r1", "_r2", "_own", "contaminated", "most_matches", "id")
    rows = [(1, "The first line of this page is here\nalpha beta gamma delta epsilon y"), (2, "the first line of this page is here"), (3, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    found = {x["doc_id"]: x for x in dedup_lines(made).collect()}
    assert found[2]["text"] == "" and found[2]["lines_removed"] == 1 and found[2]["first_ids"] == [1] and found[1]["_r1"] == "_r1"
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {x["doc_id"]: x for x in decontaminate(made, items).collect()}
    assert found[1]["contaminated"] is True and found[1]["item_ids"] == [2] and found[3]["contaminated"] is False
    assert found[1]["_r2"] == "_r2" and found[1]["lines_removed"] == "lines_removed" and "contaminated" in found[1].asDict()


def test_native_plans_have_no_python(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for made in (exact_dedup(docs), decontaminate(docs, items), dedup_lines(docs)):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_signatures_of_long_and_repetitive_lines_are_the_least_hashes(spark):
    """Values are collected below a bound; lines that repeat themselves have few below it, or none."""
    lines = ["ab" * 400, "=" * 900, "äö😀" * 300, "".join(words(41, 400)), "é😀" + " ".join(words(42, 300)), "x" * 16, "short line of some 30 letters", "abc" * 30]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(50, "\n".join(lines)), (51, None)], "doc_id long, text string")
    source = line_dedup._source(made, "doc_id", "text")
    known, rest = line_dedup._signatures(source, None)
    found = known.where("not short").select("h1", "h2", "least").unionByName(rest)
    every = line_dedup._hashed(line_dedup._texts(line_dedup._lines(source))).groupBy("h1", "h2").agg(F.collect_set("h").alias("all"))
    both = found.join(every, ["h1", "h2"]).collect()
    assert len(both) == found.count() == len(lines) and not rest.isEmpty()
    assert all(r["least"] == sorted(r["all"])[:16] for r in both)
    sizes = sorted(len({t[k:k + 16] for k in range(len(t) - 15)}) for t in lines)
    assert sorted(len(r["all"]) for r in both) == sizes
    assert {r["n"] for r in known.collect()} == {2}


def test_lines_that_share_one_passage_are_not_verified(spark):
    """Lines with a common passage meet in buckets; their signatures say that they are not similar."""
    passage = "".join(words(51, 12))[:40]
    rows = [(i, passage + "".join(words(600 + i, 60))) for i in range(60)] + [(90, passage + "".join(words(600, 60)) + "z")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    known, rest = line_dedup._signatures(line_dedup._source(made, "doc_id", "text"), None)
    meets, _ = line_dedup._meetings(known, rest, 75, None)
    assert meets.select("node").distinct().count() < 10
    found = {r["doc_id"]: r["text"] for r in dedup_lines(made).collect()}
    assert found == {**dict(rows), 90: ""}


def test_lines_are_verified_from_their_texts(spark):
    """The shingles of a line are hashed behind the joins: what travels and is stored is the line."""
    lines = ["ab" * 60, "=" * 90, "äö😀" * 30, "x" * 16, "é😀" + " ".join(words(42, 30)), " ".join(words(42, 30))]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "node long, normal string")
    wide = texts.select("node", F.encode("normal", "UTF-32").alias("wide"))
    sets = {r["node"]: r["s"] for r in wide.select("node", line_dedup._shingles(F.col("wide")).alias("s")).collect()}
    want = {r["node"]: r["s"] for r in line_dedup._hashed(texts).groupBy("node").agg(F.collect_set("h").alias("s")).collect()}
    assert {i: sorted(s) for i, s in sets.items()} == {i: sorted(s) for i, s in want.items()}
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(a)], "a long, b long")
    links = line_dedup._verified(pairs, texts, 75, 3)
    assert [tuple(r) for r in links.collect()] == [(5, 4)]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_intersect") < plan.index("xxhash64") < plan.index("Join") and "collect_set" not in plan
