"""Connected components by contraction: union-find without a shared memory.

In a round every node hangs on its smallest neighbour, or on itself; chains of such links are
shortened by pointer jumping until each hangs on a root, and edges between nodes become edges
between their roots. At least half of the nodes that still have edges are gone after a
round, and stars around small nodes, which is what near duplicates give, need one round.

All joins are equality joins of stored tables one of which has a row per node, so adaptive
execution can split a node with a third of all edges over many tasks; minima are combined
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import drop, store


def _roots(edges: DataFrame) -> DataFrame:
    """(``a``, ``m``): each node of an edge with the root of its chain of smallest neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    while True:
        further = now.select(F.col("a").alias("m"), F.col("m").alias("further"))
        moves = now.join(further.where("further != m"), "m").select("a", "further")
        moves = store(moves)
        if moves.isEmpty():
            drop(moves)
            return now
        jumped = store(now.join(moves, "a", "left").select("a", F.coalesce("further", "m").alias("m")))
        drop(now, moves)
        now = jumped


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node of an edge that is not its component's smallest.

    ``component`` is the smallest node that can be reached. Edges with a missing end and
    loops are ignored; repeated edges and both directions are fine. Nodes that are the
    smallest of their component, or have no edge, have no row. The result is a stored table.
    """
    pair = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = store(pair.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    labels = None
    while True:
        roots = _roots(now)
        if labels is None:
            labels = store(roots.where("a != m").select(F.col("a").alias("node"), F.col("m").alias("component")))
        else:
            above = roots.select(F.col("a").alias("component"), F.col("m").alias("_m"))
            # a root so far may hang on another one now: it gets a row of its own
            moved = labels.join(above, "component", "left").select("node", F.coalesce("_m", "component").alias("component"))
            new = roots.where("a != m").select(F.col("a").alias("node"), F.col("m").alias("component"))
            joined = store(moved.unionByName(new.join(labels.select("node"), "node", "left_anti")))
            drop(labels)
            labels = joined
        left = now.join(roots.withColumnRenamed("m", "ma"), "a").join(roots.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
        left = store(left.where("ma != mb").select(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b")).distinct())
        drop(now, roots)
        if left.isEmpty():
            drop(left)
            return labels
        now = left
