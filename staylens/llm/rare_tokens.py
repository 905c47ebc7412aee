"""All similar pairs among sets that share much with many others, by their rarest tokens.

Sets that meet in a crowded bucket mostly share a passage that very many have. Their
tokens are put in one order, the rarest first. Two sets with a Jaccard similarity of ``percent``
or more must then share a token among the first few of each: those left over if all
required ones came last. A common passage comes last in that order, so it makes no pairs;
what does are tokens that few sets have. The place of a token in both sets bounds what they
share: pairs that meet too late for their sizes are not made, since if they are similar they have
met before. Nothing is missed, and no bucket is paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import drop, store


def _ceil(over: Column, under: int) -> Column:
    return F.floor((over + (under - 1)) / under).cast("int")


def _most(left: Column, n: Column, percent: int) -> Column:
    """The size of the largest set that may be similar to one of ``n`` tokens by sharing ``left`` of them."""
    return F.floor(left * (100 + percent) / percent).cast("int") - n


def rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) from (node, c, shingles): pairs of different components that may be similar.

    ``c`` is the component a node is known to be in; nodes of one component are not paired, and
    where a token is shared by several components, those of the largest one are paired with the
    others only. Every pair of nodes of different components whose sets have a Jaccard
    similarity of ``percent`` or more is among them. Nodes are distinct, sets have no repeats.
    The result is stored.
    """
    n = F.size("shingles")
    # the tokens travel with a hash of their node, and once: counted where they meet
    key = F.xxhash64("node").alias("key")
    tokens = sets.select(key, F.explode("shingles").alias("token"))
    shared = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token")).cast("int")).where("df > 1")
    found = shared.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    known = sets.select(key, "node", "c", n.alias("n")).join(found, "key")
    # tokens that no other set has come first of all
    alone = F.col("n") - F.size("shared")
    probing = F.col("n") - _ceil(F.col("n") * percent, 100) + 1 - alone
    first = known.withColumns({"alone": alone, "probing": probing}).where("probing > 0")
    first = first.select("node", "c", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("probing"))).alias("at", "x"))
    left = F.col("n") - F.col("alone") - F.col("at")
    first = store(first.select(F.col("x.token").alias("token"), "node", "c", "n", _most(left, F.col("n"), percent).alias("most")))

    counts = first.groupBy("token", "c").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"))
    mains = counts.groupBy("token").agg(
        F.max_by("c", F.struct("size", "c")).alias("main"), F.count(F.lit(1)).alias("several"), F.min("least").alias("least")
    )
    mains = mains.where("several > 1").select("token", "main", "least")
    # what is left of a set after this token may be too little for any that has it
    meets = store(first.join(mains, "token").where("most >= least").drop("least"))
    drop(first)
    asking = meets.where("c != main").select("token", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("most").alias("ma"))
    others = meets.select("token", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"), "main")
    met = asking.join(others, "token").where("ca != cb and (cb = main or a > b)")
    # two sets share no more than what is left of each from their first common token on
    met = met.where("nb <= ma and na <= mb").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = store(met.select("a", "b").distinct())
    drop(meets)
    return pairs
