"""Spark session with the settings the operators are tested under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


# Partitions a shuffle starts with on a cluster; adaptive execution merges the small ones.
CLUSTER_PARTITIONS = 20_000


def build_session(
    app_name: str = "staylens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with ANSI mode, adaptive execution and UTC time.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster: the submit
    command names the master, and adaptive execution coalesces a generous
    partition count to what the data needs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # call sites of column expressions are not recorded: plans build faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.ui.enabled", "false")
                .config("spark.ui.showConsoleProgress", "false")
                .config("spark.driver.memory", os.environ.get("STAYLENS_DRIVER_MEMORY", "8g"))
            )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif master is None or not master.startswith("local"):
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(CLUSTER_PARTITIONS))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
