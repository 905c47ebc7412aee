"""Audit of how far the sources of a language diverge in the terms they use.

Terms are counted by Arrow kernels inside ``mapInArrow``: lower case, split by a pattern,
dictionary codes, hash aggregation. Each task sends partial counts, Spark merges them, and
the merged counts are cut into shards of one language's terms: a shard is a matrix of
sources by terms from which it gives its part of every distance between two sources and
its own leading terms. Only these parts are summed and ranked at the end.

All figures are whole numbers. The share of a term with count c in a group of N kept
occurrences and V kept terms is ``1 + floor(10^9 * (c + 5) / (N + 5 * V))``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import bound_batches, store, text_or_empty

# What lies between terms: all of ASCII but its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
PRIOR = 5
LEAST_DOCS = 30
LEADING = 50
# Cells of the matrix of a shard, sources by terms; at least as many terms as sources.
SHARD_CELLS = 40_000
# Counts of a task are merged and sent when so many have gathered.
HELD_ROWS = 400_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of one batch of (lang, source, text); a row without term per group."""
    langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
    group = pc.add(pc.multiply(pc.cast(langs.indices, pa.int64()), max(1, len(sources.dictionary))), pc.cast(sources.indices, pa.int64()))
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), BETWEEN)
    terms, row = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int64())
    filled = pc.not_equal(terms, "")
    terms, row = terms.filter(filled).dictionary_encode(), row.filter(filled)
    # occurrences per row and term, then rows and occurrences per group and term
    seen = pa.table({"row": row, "code": terms.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    seen = pa.table({"group": group.take(seen["row"].combine_chunks()), "code": seen["code"], "n": seen["count_all"]})
    seen = seen.group_by(["group", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    term = terms.dictionary.take(seen["code"].combine_chunks())
    alone = pc.unique(group)
    zero = pa.array(np.zeros(len(alone), np.int64))
    every = pa.concat_arrays([seen["group"].combine_chunks(), alone])
    width = max(1, len(sources.dictionary))
    lang = pc.divide(every, width)
    columns = [
        langs.dictionary.take(lang),
        sources.dictionary.take(pc.subtract(every, pc.multiply(lang, width))),
        pa.concat_arrays([term.cast(pa.string()), pa.nulls(len(alone), pa.string())]),
        pa.concat_arrays([seen["n_sum"].combine_chunks().cast(pa.int64()), zero]),
        pa.concat_arrays([seen["count_all"].combine_chunks().cast(pa.int64()), zero]),
    ]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)


def _merged(tables: list[pa.Table]) -> pa.Table:
    joined = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.Table.from_arrays([joined[c].cast(f.type) for c, f in zip(("lang", "source", "term", "n_sum", "docs_sum"), _COUNTS)], schema=_COUNTS)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and the rows that hold it.

    Each group has one more row without a term and with zero counts, so that groups whose
    texts have no terms are there as well.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(*[text_or_empty(c).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_batch_counts(batch))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held, rows = [], 0
        if held:
            yield from _merged(held).to_batches(max_chunksize=100_000)

    schema = "lang string, source string, term string, n long, docs long"
    partial = source.mapInArrow(work, schema)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


_RESULT = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("item", T.StringType()), T.StructField("value", T.LongType()),
])


def _shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (c + 5) / (N + 5 V)); past 64 bits with Python's own numbers."""
    below = int(total) + PRIOR * int(kept)
    if (int(counts.max(initial=0)) + PRIOR) * SCALE < 2**63 and below < 2**62:
        return 1 + (counts + PRIOR) * SCALE // below
    return np.array([1 + (int(c) + PRIOR) * SCALE // below for c in counts.ravel()], np.int64).reshape(counts.shape)


def _shard(table: pa.Table, leading: int) -> pa.Table:
    """The parts of one shard from rows (source, term, n, kept) of one language: a null source stands for the
    language itself, a null term for a whole group."""
    frame = table.to_pandas()
    whole = frame[frame["term"].isna()]
    names = sorted(whole["source"].dropna())
    totals = dict(zip(whole["source"].dropna(), whole["n"][whole["source"].notna()]))
    total = int(whole["n"][whole["source"].isna()].iloc[0])
    kept = int(whole["kept"].iloc[0])
    counts = frame[frame["term"].notna()]
    lang = frame["lang"].iloc[0]
    terms, at = np.unique(counts["term"].to_numpy(object), return_inverse=True)
    place = {s: i for i, s in enumerate(names)}
    own = counts["source"].isna().to_numpy()
    n = counts["n"].to_numpy(np.int64)
    matrix = np.zeros((len(names), len(terms)), np.int64)
    matrix[[place[s] for s in counts["source"][~own]], at[~own]] = n[~own]
    base = np.zeros(len(terms), np.int64)
    base[at[own]] = n[own]
    share = np.stack([_shares(matrix[i], totals[s], kept) for s, i in place.items()]) if len(terms) else matrix
    of_lang = _shares(base, total, kept)
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
    for i, name in enumerate(names):
        apart = np.abs(share - share[i]).sum(1)
        others = [j for j in range(len(names)) if j != i]
        out["source"] += [name] * len(others)
        out["part"] += ["pair"] * len(others)
        out["item"] += [names[j] for j in others]
        out["value"] += apart[others].tolist()
        above = np.flatnonzero((matrix[i] > 0) & (share[i] > of_lang))
        value = (share[i] - of_lang)[above]
        # values descending; np.unique has put the terms in order of their code points, which is that of UTF-8
        first = above[np.lexsort((above, -value))][:leading]
        out["source"] += [name] * len(first)
        out["part"] += ["term"] * len(first)
        out["item"] += terms[first].tolist()
        out["value"] += (share[i] - of_lang)[first].tolist()
    size = len(out["source"])
    arrays = [pa.array([lang] * size, pa.string()), *[pa.array(out[c], pa.int64() if c == "value" else pa.string()) for c in ("source", "part", "item", "value")]]
    return pa.Table.from_arrays(arrays, names=["lang", "source", "part", "item", "value"])


def audit_sources(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    leading: int = LEADING,
    shard_cells: int = SHARD_CELLS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source that occurs.

    Terms are runs of letters, A-Z in lower case; a language keeps those in at least
    ``least_docs`` of its rows. Part ``pair`` has a row for each other source of the language
    with the sum of the differences of shares over all kept terms. Part ``term`` has the kept
    terms that the source uses more than the language as a whole, up to rank ``leading``. Ranks
    start at 1 per group and part, by value downwards, then item in order of UTF-8. Missing
    texts, languages and sources are empty strings, repeated rows count each, an empty table
    gives no rows, other columns are not read. A language without kept terms has distances of
    0 and no terms; a source that is alone in its language has no pairs.
    """
    counts = store(term_counts(docs, text_col, lang_col, source_col))
    places = Window.partitionBy("lang", "term")
    used = counts.where("term is not null").select(
        "lang", "source", "term", "n", F.sum("docs").over(places).alias("docs"), F.sum("n").over(places).alias("of_lang")
    )
    used = store(used.where(F.col("docs") >= least_docs).drop("docs"))
    # one row per language and source: its kept occurrences, the kept terms of the language, its number of sources
    groups = counts.where("term is null").select("lang", "source")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = used.groupBy("lang", "term").agg(F.any_value("of_lang").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(langs, "lang", "left")
    langs = langs.select(
        "lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"),
        F.ceil(F.greatest(F.coalesce("kept", F.lit(0)), F.lit(1)) / F.greatest(F.lit(shard_cells) / F.col("sources"), "sources")).alias("shards"),
    )
    langs = store(langs)

    # a shard gets its terms, the language's own counts of them, and every group of the language
    spread = F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard")
    narrow = langs.select("lang", "shards")
    of_source = used.select("lang", "source", "term", "n").join(narrow, "lang").select("lang", spread, "source", "term", "n", F.lit(0).cast("long").alias("kept"))
    of_lang = kept.join(narrow, "lang").select("lang", spread, F.lit(None).cast("string").alias("source"), "term", "n", F.lit(0).cast("long").alias("kept"))
    whole = groups.join(totals, ["lang", "source"], "left").unionByName(langs.select("lang", F.lit(None).cast("string").alias("source"), F.col("total").alias("n")))
    whole = whole.join(langs.select("lang", "kept", "shards"), "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "source",
        F.lit(None).cast("string").alias("term"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("kept").cast("long").alias("kept"),
    )
    rows = of_source.unionByName(of_lang).unionByName(whole)
    parts = rows.groupBy("lang", "shard").applyInArrow(lambda t: _shard(t, leading), _RESULT)
    found = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= leading))
