"""Source divergence against SQL and a plain version."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import oracle
from staylens.llm import queries
from staylens.llm.divergence import _shares, audit_sources

TERM = re.compile("[A-Za-z\u0080-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least):
    """{(lang, source, part, item, value, rank)} of (text, lang, source) rows."""
    counts, seen, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall((text or "").translate(LOWER))
        seen.update({(lang, t) for t in found})
        counts.update((lang, source, t) for t in found)
    out = set()
    for lang, sources in groups.items():
        terms = [t for (g, t), n in seen.items() if g == lang and n >= least]
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(terms))
        p = {}
        for s in sources:
            n = sum(counts[lang, s, t] for t in terms)
            p[s] = {t: share(counts[lang, s, t], n) for t in terms}
        total = {t: sum(counts[lang, s, t] for s in sources) for t in terms}
        q = {t: share(c, sum(total.values())) for t, c in total.items()}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[u][t]) for t in terms), u.encode(), u) for u in sources if u != s]
            out |= {(lang, s, "pair", u, -v, k + 1) for k, (v, _, u) in enumerate(sorted(pairs))}
            above = [(q[t] - p[s][t], t.encode(), t) for t in terms if counts[lang, s, t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(above)[:50])}
    return out


def made_rows():
    r = random.Random(4)
    words = [f"{x}{y}" for x in ("Wort", "été", "ÉTÉ", "日本", "a", "Zebra") for y in ("", "s", "x", "ö")]
    rows = []
    for i in range(300):
        source = r.choice(["a", "b", "ä", "Z"])
        picked = r.choices(words[: 12 if source == "a" else 24], k=r.randrange(40))
        rows.append((r.choice([" ", ", ", "\n1-"]).join(picked), r.choice(["en", "de"]), source))
    rows += [(None, "en", "a"), ("", "fr", "alone"), ("rare term", "es", "x"), ("other", "es", "y"), ("Wort", None, None), (" \t", "en", "silent")]
    return rows + rows[:5]


@pytest.mark.parametrize("cells", [250_000, 20])
def test_against_plain_version(spark, cells):
    rows = made_rows()
    made = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(c) for c in ("term", "n", "item", "part", "rank", "shard")})
    found = [tuple(r) for r in audit_sources(made.repartition(3), least_docs=10, shard_cells=cells).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, 10)


def test_query_equals_sql(spark, sf_dir):
    name = "op12_source_divergence"
    assert oracle.compare(spark, oracle.connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_long_text_and_empty_table(spark):
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(60_000))
    rows = [(text, "en", "a")] * 30 + [("waa", "en", "b")]
    found = {tuple(r) for r in audit_sources(spark.createDataFrame(rows, "text string, lang string, source string")).collect()}
    assert found == plain(rows, 30)
    assert audit_sources(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_do_not_overflow():
    import numpy as np

    big = np.array([0, 1, 9 * 10**12], np.int64)
    assert _shares(big, 10**14, 10**6).tolist() == [1 + 10**9 * (int(c) + 5) // (10**14 + 5 * 10**6) for c in big]
