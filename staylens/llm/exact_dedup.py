"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Most texts are told apart by their length, most of the rest by the hash of their first
characters; whole texts are hashed only where both agree with some other row. What is
shuffled at every level is a narrow key with a count, pre-aggregated before the
shuffle, so a group with a third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import lookup, sized, store, text_or_empty
from staylens.runtime import SizedTable


def without_spaces(text: Column) -> Column:
    """The text with every character of ``[\\x20\\x09-\\x0D]`` deleted."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _repeated(df: DataFrame, keys: Sequence[str], limit: int | None) -> SizedTable:
    """The keys that more than one row has."""
    return sized(df.groupBy(*keys).count().where("count > 1").select(*keys), limit)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    prefix: int = 128,
    limit: int | None = None,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and ``carry``.

    Texts are equal when they are the same without white space. Of equal texts the row
    with the most characters stays, then the smallest id; a missing id comes last. A
    missing text is an empty one, and empty texts equal one another. If the row that
    stays is itself repeated (same id, same length, same carried values), one of the
    repeats is kept. ``prefix`` is the number of characters in the prefix hash;
    ``limit`` overrides the size up to which a measured table is broadcast. Columns of
    ``docs`` other than the id, the text and ``carry`` are not read.
    """
    carried = [f"_c{i}" for i in range(len(carry))]
    source = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        text_or_empty(text_col).alias("_text"),
        *[F.col(f"`{c}`").alias(a) for c, a in zip(carry, carried)],
    ).withColumn("_plain", without_spaces(F.col("_text")))
    rows = source.select(
        "_id",
        *carried,
        F.length("_text").alias("_points"),
        F.length("_plain").alias("_length"),
        F.xxhash64(F.substring("_plain", 1, prefix)).alias("_head"),
        "_plain",
    )
    narrow = store(rows.drop("_plain"))

    lengths = _repeated(narrow, ["_length"], limit)
    heads = _repeated(lookup(narrow, lengths, ["_length"], "left_semi"), ["_length", "_head"], limit)
    alone = lookup(narrow, heads, ["_length", "_head"], "left_anti").select(
        "_id",
        *carried,
        F.col("_id").alias("_keep"),
        F.lit(1).cast("long").alias("_size"),
        F.lit(True).alias("_kept"),
    )

    full = F.sha2("_plain", 256).alias("_full")
    key = ["_length", "_full"]
    columns = ["_id", *carried, "_points", "_length", "_head"]
    if heads.fits:
        # the filter runs where the text is read; only survivors are hashed whole
        survivors = lookup(rows, heads, ["_length", "_head"], "left_semi").select(*columns, full)
    else:
        # too many survivors to broadcast: hash first, so that no text is shuffled
        survivors = lookup(rows.select(*columns, full), heads, ["_length", "_head"], "left_semi")
    survivors = store(survivors.drop("_head"))
    order = F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"))
    groups = sized(
        survivors.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_first"))
        .select(*key, "_size", F.col("_first.i").alias("_keep"), (-F.col("_first.p")).alias("_most")),
        limit,
    )
    judged = lookup(survivors, groups, key, "inner").select(
        "_id", *carried, "_keep", "_size",
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_points") == F.col("_most"))).alias("_stays"),
    )
    # a row that stays may be repeated: count its repeats, keep the first of them
    stays = (
        judged.where("_stays")
        .groupBy("_id", *carried, "_keep", "_size")
        .count()
        .select("_id", *carried, "_keep", "_size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("_n"))
        .select("_id", *carried, "_keep", "_size", (F.col("_n") == 1).alias("_kept"))
    )
    goes = judged.where(~F.col("_stays")).select("_id", *carried, "_keep", "_size", F.lit(False).alias("_kept"))
    return (
        alone.unionByName(stays)
        .unionByName(goes)
        .select(
            F.col("_id").alias(id_col),
            F.col("_keep").alias("keep_id"),
            F.col("_size").alias("group_size"),
            F.col("_kept").alias("kept"),
            *[F.col(a).alias(c) for c, a in zip(carry, carried)],
        )
    )
