"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.runtime import SizedTable, measure, use_checkpoint_dir

# Characters that separate words in every contract of this subpackage: [\x20\x09-\x0D].
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BATCH_BYTES = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    """The text as a string, empty where it is missing."""
    return F.coalesce((F.col(f"`{text}`") if isinstance(text, str) else text).cast("string"), F.lit(""))


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can read, so that a lost
    executor costs a re-read and never another value.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`store` wrote and that nothing reads any more, then :func:`tidy`.

    To be called when the next step is stored itself.
    """
    context = tables[0].sparkSession.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    for made in tables:
        path = jvm.org.apache.hadoop.fs.Path(made.stored_at)
        path.getFileSystem(conf).delete(path, True)
    tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps.

    It does so when the driver's garbage collector finds the plans unused; a job of many steps
    would keep the files until the driver happens to run short of memory. The second hint
    comes when Spark's listeners have let go of the last step's plan.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Cap Arrow batches in bytes: 10,000 very long texts would not fit in one batch.

    Only how many rows travel at a time changes, never which. A session that
    already sets a bound keeps it.
    """
    for key in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxBytesPerOutputBatch"):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > size:
            spark.conf.set(key, str(size))


def lookup(df: DataFrame, side: SizedTable, on: Sequence[str], how: str) -> DataFrame:
    """Join with a measured table: broadcast within its limit, else shuffled.

    Past the limit the join is a plain equality join whose keys are unique on the
    side of the table, so adaptive execution can split a hot key of ``df`` over many
    tasks: each part meets the single row of that key.
    """
    return df.join(F.broadcast(side.df) if side.fits else side.df, list(on), how)


def sized(df: DataFrame, limit: int | None = None) -> SizedTable:
    """Store a table and measure what was stored."""
    return measure(store(df), limit)
