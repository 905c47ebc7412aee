"""Materialising small results and joining against them safely.

Two rules of the library live here:

* a side of a join is broadcast only after its size has been *measured*; past the
  limit the join is shuffled instead, with hot keys spread as often as a sketch of the
  keys finds necessary, and with the same result;
* lineage is cut with a reliable checkpoint only, so a lost executor can never
  change a result that two branches of a plan both read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Keys a sketch of a join side reports at most, and those it keeps track of: it finds every key
# with more than about 4 / SKETCH_ITEMS of the rows.
HOT_KEYS = 1_000
SKETCH_ITEMS = 10_000

# Rough in-memory bytes of one value, used to turn a row count into a size.
_FIXED_WIDTH = 16
_ROW_OVERHEAD = 32


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure checkpoints go to the folder that ``spark.checkpoint.dir`` names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder that every executor shares"
            )
        folder = tempfile.mkdtemp(prefix="staylens-checkpoint-")
    context.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and store it in the shared checkpoint folder."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_columns(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and store it by columns in the shared checkpoint folder.

    For a table that many steps read a few columns of: a checkpoint gives whole rows to each.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/columns-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class SizedTable:
    """A table whose size has been measured."""

    df: DataFrame
    rows: int
    size: int
    limit: int

    @property
    def fits(self) -> bool:
        return self.size <= self.limit


def measure(df: DataFrame, limit: int | None = None) -> SizedTable:
    """Count the rows and bytes of ``df`` with one small aggregate."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    widths = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in wide]
    row_bytes = sum(widths, F.lit(_ROW_OVERHEAD + _FIXED_WIDTH * len(df.columns))).cast("long")
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()
    return SizedTable(df, found["n"], found["b"], BROADCAST_LIMIT_BYTES if limit is None else limit)


def materialize_sized(df: DataFrame, limit: int | None = None) -> SizedTable:
    return measure(materialize(df), limit)


def hot_keys(df: DataFrame, on: Sequence[str], parts: int) -> DataFrame | None:
    """(_hot_key, _hot_copies): hashes of the keys that hold more than a fair share of the rows of ``df``.

    A share is the rows over ``parts``; a key gets a copy per share it holds. Found by one
    mergeable sketch of frequent items in one scan of the key columns, so at most ``HOT_KEYS``
    numbers leave the tasks. None where no key is hot.
    """
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    sketch = F.expr(f"approx_top_k(_hot_key, {HOT_KEYS}, {SKETCH_ITEMS})")
    found = df.select(key.alias("_hot_key")).agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).first()
    fair = max(1, found["n"] // parts)
    hot = [(x["item"], -(-x["count"] // fair)) for x in found["top"] or [] if x["count"] > fair]
    return df.sparkSession.createDataFrame(hot, "_hot_key long, _hot_copies long") if hot else None


def join_sized(
    df: DataFrame,
    side: SizedTable,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    parts: int | None = None,
) -> DataFrame:
    """Join ``df`` to a measured table.

    Within the limit the table is broadcast and ``df`` is not shuffled. Past it both are
    shuffled by the key. Only rows of ``side`` whose key is hot in ``df`` are copied, as often as
    the key holds shares of ``1 / parts`` (the shuffle partitions of the session), and the rows
    of ``df`` with that key choose a copy by a hash of the ``spread`` columns. The hash depends
    on the row alone: a retried task puts it in the same place. ``df`` is read once more for
    the sketch of its keys.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    on = list(on)
    if side.fits:
        return df.join(F.broadcast(side.df), on, how)
    hot = hot_keys(df, on, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if hot is None:
        return df.join(side.df, on, how)
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    copies = F.coalesce("_hot_copies", F.lit(1))
    draw = F.pmod(F.xxhash64(F.lit("copy"), *[F.col(f"`{c}`") for c in spread]), copies)

    def marked(table: DataFrame) -> DataFrame:
        return table.withColumn("_hot_key", key).join(F.broadcast(hot), "_hot_key", "left")  # at most HOT_KEYS rows

    salted = marked(df).withColumn("_hot_salt", draw).drop("_hot_key", "_hot_copies")
    spare = marked(side.df).withColumn("_hot_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_hot_key", "_hot_copies")
    return salted.join(spare, [*on, "_hot_salt"], how).drop("_hot_salt")
