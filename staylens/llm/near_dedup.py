"""Near duplicates: SetSketch registers, banded, estimated by likelihood, verified on full sets.

The aim is the components of the graph whose links join texts with a Jaccard similarity
of at least 0.75, not a list of links: pairs that a chain of links joins already need
no comparison. Equal sets are one node. Nodes that share a band meet in a bucket.

1. Every node is verified against one node: the smallest that leads any of its buckets.
2. It is verified against the other leaders of its buckets that are still elsewhere.
3. Members of buckets that still hold several components are paired by their rarest shingles;
   pairs that the likelihood estimate leaves open are verified.

So a group of copies costs about one verification a copy, texts that share a passage and are
otherwise different make no pairs, and no similar pair of different components that meets
in a bucket goes unjudged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import bound_batches, drop, lookup, sized, store, text_or_empty
from staylens.llm.components import components
from staylens.llm.rare_tokens import rare_pairs
from staylens.llm.shingles import REGISTERS, jaccard_estimate, registers, set_key, shingle_set

BAND_ROWS = 4
PERCENT = 75
# A pair is left unverified only when its estimate lies five standard deviations below the threshold.
SLACK = 5.0


def _sketch(docs: DataFrame) -> DataFrame:
    """(id, n, key, regs) from (id, text)."""
    schema = T.StructType([
        docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("regs", T.BinaryType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, regs = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py())
                n.append(len(found))
                keys.append(set_key(found))
                regs.append(registers(found).tobytes() if len(found) else b"")
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "key", "regs"])

    return docs.mapInArrow(work, schema)


def _sets(docs: DataFrame) -> DataFrame:
    """(id, shingles) from (id, text)."""
    schema = T.StructType([docs.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["id", "shingles"])

    return docs.mapInArrow(work, schema)


def _codes(regs: np.ndarray) -> np.ndarray:
    """The bucket of every band: a hash of band and registers."""
    bands = REGISTERS // BAND_ROWS
    rng = np.random.Generator(np.random.PCG64(7))
    factors = rng.integers(0, 2**63, (bands, BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
    starts = rng.integers(0, 2**63, bands, np.uint64)
    banded = regs.reshape(-1, bands, BAND_ROWS)
    code = np.repeat(starts[None, :], len(banded), 0)
    for j in range(BAND_ROWS):
        code = (code ^ banded[:, :, j].astype(np.uint64)) * factors[None, :, j]
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node): one row per node and band."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("node", nodes.schema["node"].dataType)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _codes(np.frombuffer(b"".join(r.as_py() for r in batch.column(1)), np.uint16))
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(code)), code.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), node], names=["bucket", "node"])

    return nodes.select("node", "regs").mapInArrow(work, schema)


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    left, right = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (a, b))
    return pd.Series(jaccard_estimate(left, right, n_a.to_numpy(float), n_b.to_numpy(float)))


class _Judge:
    """Estimates and verifies pairs of nodes."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int) -> None:
        self.nodes, self.sets, self.percent = nodes, sets, percent
        share = percent / 100
        self.floor = share - SLACK * (share * (1 - share) / REGISTERS) ** 0.5

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate does not rule them out, with the estimate."""
        a = self.nodes.select(F.col("node").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
        b = self.nodes.select(F.col("node").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
        # sizes alone rule out what no overlap could mend
        sized_pairs = pairs.join(b, "b").join(a, "a").where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        return sized_pairs.withColumn("likely", _estimate("ra", "rb", "na", "nb")).drop("ra", "rb", "na", "nb").where(F.col("likely") >= self.floor)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough.

        The leader ``b`` may stand in very many pairs, so its set joins first, while the
        pairs are narrow; what is shuffled next goes by ``a``, which is spread evenly.
        """
        a = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        b = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        either = F.size("sa") + F.size("sb") - both
        return pairs.select("a", "b").join(b, "b").join(a, "a").where(100 * both >= self.percent * either).select("a", "b")


def _label(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of a node: itself where it has no other."""
    side = labels.select(F.col("node").alias(node), F.col("component").alias("_c"))
    return df.join(side, node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, limit: int | None = None) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked when 100 * intersection >= ``percent`` * union of their sets of five-word
    shingles; ``component_id`` is the smallest id that links reach, ``kept`` whether it is
    the row's own. Texts without words have no shingles and link with nothing, nor with each
    other. Equal texts are linked whatever their length. Rows that share an id are one
    document and share its component; a row without an id is compared with nothing, has a
    null component and is kept. A link at the threshold is missed by all bands with a
    probability of about 5e-6, one of 0.9 with less than 1e-14. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    sketches = store(_sketch(source))
    known = sketches.where("n > 0 and id is not null")
    nodes = store(known.groupBy("key").agg(F.min("id").alias("node"), F.any_value("n").alias("n"), F.any_value("regs").alias("regs")))

    buckets = _buckets(nodes)
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    meets = store(buckets.join(shared, "bucket"))
    wanted = sized(meets.select(F.col("node").alias("id")).distinct(), limit)
    # rows of a node all have its set, but for rows that share an id and not a text
    sets = _sets(lookup(source.where("id is not null"), wanted, ["id"], "left_semi")).withColumnRenamed("id", "node")
    sets = store(sets.where(F.size("shingles") > 0))
    drop(wanted.df)
    judge = _Judge(nodes, sets, percent)

    heads = meets.where("head != node").select(F.col("node").alias("a"), F.col("head").alias("b"))
    links = store(judge.linked(heads.groupBy("a").agg(F.min("b").alias("b"))))
    labels = components(links)

    apart = _label(_label(heads.distinct(), labels, "b", "cb"), labels, "a", "ca").where("ca != cb")
    more = store(links.unionByName(judge.linked(judge.likely(apart.select("a", "b")))))
    drop(links, labels)
    labels = components(more)

    members = _label(meets.drop("head"), labels, "node", "c")
    several = members.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("bucket")
    open_ones = store(members.join(several, "bucket", "left_semi").select("node", "c").distinct())
    drop(meets)
    links = more
    if not open_ones.isEmpty():
        # rows that share an id and not a text have several sets
        one = F.struct("node", F.xxhash64("shingles").alias("set")).alias("node")
        open_sets = sets.join(open_ones, "node").select(one, "c", "shingles").dropDuplicates(["node"])
        pairs = rare_pairs(open_sets, percent).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).where("a != b").distinct()
        found = judge.linked(judge.likely(pairs))
        links = store(more.unionByName(found))
        drop(more, labels)
        labels = components(links)

    by_key = nodes.select("key", F.col("node")).join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    by_key = sized(by_key, limit)
    found = lookup(sketches.select("id", "n", "key"), by_key, ["key"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    result = store(
        found.select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
    drop(sketches, nodes, sets, open_ones, links, labels, by_key.df)
    return result
