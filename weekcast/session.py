"""Spark session helpers.

The library never creates a session behind the caller's back: every operator takes DataFrames. These
helpers exist for tests, the bench and the driver entry point, and for frames that many model fits reuse.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "weekcast") -> SparkSession:
    """Local session with the settings the tests and the bench use.

    On a cluster, build the session there and pass it in; nothing here is required by the operators.
    """
    master = master or os.environ.get("WEEKCAST_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("WEEKCAST_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder that the cluster names (``spark.checkpoint.dir``) or the caller has set."""
    try:
        current = spark.sparkContext.getCheckpointDir()
    except Exception:  # a Spark Connect session has no SparkContext; the server owns the setting
        current = None
    return current or spark.conf.get("spark.checkpoint.dir", None)


def materialize(df: DataFrame) -> DataFrame:
    """Evaluate once a frame that many jobs reuse (panels, feature and fold frames).

    With a shared checkpoint folder: a reliable checkpoint, which cuts the lineage and survives lost
    executors. Without one: persisted in memory and on disk, and recomputed from lineage on loss. The same on
    every master; never a local checkpoint, never a folder of this machine. ``release`` gives it up."""
    if _shared_folder(df.sparkSession):
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release(df: DataFrame | None) -> None:
    """Free a materialized frame. A checkpoint's files go with Spark's own cleaner
    (``spark.cleaner.referenceTracking.cleanCheckpoints``); reading the frame later still works."""
    if df is not None:
        df.unpersist()
