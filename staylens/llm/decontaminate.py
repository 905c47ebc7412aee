"""Benchmark decontamination by spaced-seed hashing, with native functions only.

A seed is a mask over a window of tokens: masked positions are ignored, so one hash finds
a window whose ignored tokens were substituted. Windows of the benchmark and of the
corpus that share a hash give an alignment (document, item, offset); along it the best
run of matching tokens is scored, substitutions at a cost, and a document is
contaminated where that run holds enough matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import lookup, sized, store, text_or_empty

# 1 = the token counts, 0 = any token may stand there.
MASKS = ("110110110111", "111001101011", "101101011101")
# Items of fewer tokens than this are searched by short masks: a long one rarely fits between
# two substitutions there. No item that the rule below accepts escapes them.
SHORT = 16
SHORT_MASKS = ("1111", "11011")
# An item of fewer tokens is not evidence.
LEAST_TOKENS = 5
# A run of the alignment needs so many matching tokens, or this share of a shorter item.
LEAST_MATCHES = 13
LEAST_SHARE = 0.75
# What a substituted token costs; a matching one counts 1.
COST = 2


def token_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, keys: Sequence[str], masks: Sequence[str]) -> DataFrame:
    """(keys, at, seed): one row per window and mask from (keys, tokens)."""
    at = df.select(*keys, "tokens", F.posexplode("tokens").alias("at", "_token"))
    hashes = []
    for mask in masks:
        used = [F.get("tokens", F.col("at") + j) for j, c in enumerate(mask) if c == "1"]
        whole = F.col("at") + len(mask) <= F.size("tokens")
        hashes.append(F.when(whole, F.xxhash64(F.lit(mask), *used)))
    return at.select(*keys, "at", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")


def _best_run(item: Column, tokens: Column, offset: Column) -> Column:
    """Matches in the best-scoring run of the alignment of an item at an offset of a text."""
    same = F.transform(item, lambda w, j: F.coalesce(w == F.get(tokens, offset + j), F.lit(False)))
    start = F.struct(*[F.lit(0).alias(n) for n in ("run", "hits", "top", "best")])

    def step(acc: Column, ok: Column) -> Column:
        score = acc["run"] + F.when(ok, 1).otherwise(-COST)
        hits = F.when(score > 0, acc["hits"] + ok.cast("int")).otherwise(0)
        return F.struct(
            F.greatest(score, F.lit(0)).alias("run"),
            hits.alias("hits"),
            F.greatest(score, acc["top"]).alias("top"),
            F.when(score > acc["top"], hits).otherwise(acc["best"]).alias("best"),
        )

    return F.aggregate(same, start, step, lambda acc: acc["best"])


def _with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add two hashes of a row's id and text, which stand for the row in narrow tables."""
    seen = [F.col(f"`{id_col}`"), text_or_empty(text_col)]
    return docs.withColumns({"_r1": F.xxhash64(*seen), "_r2": F.xxhash64(F.lit("row"), *seen)})


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    limit: int | None = None,
) -> DataFrame:
    """(_r1, _r2, id, item, matches, item_tokens): documents that hold a passage of an item.

    ``_r1`` and ``_r2`` are the keys of a row of ``docs`` (hashes of its id and text), ``matches``
    the matching tokens of the best run. Rows are distinct; repeated rows count once.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), token_hashes(text_or_empty(item_text_col)).alias("tokens"))
    items = sized(items.where(F.size("tokens") >= LEAST_TOKENS).distinct(), limit)
    brief = F.size("tokens") < SHORT
    wanted = _seeds(items.df.where(~brief), ["item", "tokens"], MASKS).unionByName(_seeds(items.df.where(brief), ["item", "tokens"], SHORT_MASKS))
    wanted = sized(wanted.select("item", F.size("tokens").alias("size"), F.col("at").alias("q"), "seed"), limit)
    masks = MASKS if items.df.where(brief).isEmpty() else (*MASKS, *SHORT_MASKS)

    keyed = _with_rows(docs, id_col, text_col).select("_r1", "_r2", F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    windows = _seeds(keyed.select("_r1", "_r2", token_hashes(F.col("text")).alias("tokens")), ["_r1", "_r2"], masks)
    hits = lookup(windows, wanted, ["seed"], "inner").select("_r1", "_r2", "item", "size", (F.col("at") - F.col("q")).alias("offset"))
    hits = sized(hits.distinct(), limit)

    rows = sized(hits.df.select("_r1", "_r2").distinct(), limit)
    texts = lookup(keyed, rows, ["_r1", "_r2"], "left_semi").select("_r1", "_r2", "id", token_hashes(F.col("text")).alias("words"))
    aligned = lookup(texts, hits, ["_r1", "_r2"], "inner")
    side = items.df.select("item", F.col("tokens").alias("item_tokens"), F.size("tokens").alias("size"))
    aligned = aligned.join(F.broadcast(side) if items.fits else side, ["item", "size"])
    judged = aligned.select("_r1", "_r2", "id", "item", F.col("size").alias("item_tokens"), _best_run(F.col("item_tokens"), F.col("words"), F.col("offset")).alias("matches"))
    return (
        judged.where(F.col("matches") >= F.least(F.ceil(F.col("item_tokens") * LEAST_SHARE), F.lit(LEAST_MATCHES)))
        .groupBy("_r1", "_r2", "id", "item", "item_tokens")
        .agg(F.max("matches").alias("matches"))
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    limit: int | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``item_ids``, ``most_matches`` and ``contaminated``.

    A document is contaminated by an item when along some alignment a run of its tokens
    matches at least 13 tokens of the item, or three quarters of them if that is less,
    where a substituted token takes off two matches' worth. Tokens are runs of letters and digits in lower
    case. Items of fewer than 5 tokens contaminate nothing, missing texts are empty,
    repeated rows and items give repeated, equal results. Whole texts are read. A column of
    ``docs`` with the name of an added one is replaced by it. Up to 15 tokens no overlap that
    the rule accepts is missed; of longer items at least nine of ten with a fifth of the tokens
    substituted, and 98 of 100 with a tenth.
    """
    found = find_overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, limit)
    found = found.groupBy("_r1", "_r2").agg(F.array_sort(F.collect_set("item")).alias("_items"), F.max("matches").alias("_most"))
    side = sized(found, limit)
    # the caller's columns travel in one, so that none can clash
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")
    rows = _with_rows(docs.select(own, F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")), "id", "text")
    joined = lookup(rows.select("_own", "_r1", "_r2"), side, ["_r1", "_r2"], "left")
    added = {
        "item_ids": F.coalesce("_items", F.array().cast(side.df.schema["_items"].dataType)),
        "most_matches": F.coalesce("_most", F.lit(0)).cast("long"),
        "contaminated": F.col("_items").isNotNull(),
    }
    kept = [F.col(f"_own.`{c}`") for c in docs.columns if c not in added]
    return joined.select(*kept, *[c.alias(name) for name, c in added.items()])
