"""Session helpers: one place for the Spark settings the operators assume."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerscope") -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    On a cluster the master and sizing come from spark-submit; locally we
    default to ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    elif not os.environ.get("SPARK_MASTER"):
        builder = builder.master("local[*]")
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEDGERSCOPE_DRIVER_MEM", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment (shared storage) and
    is used as is. Only when it is unset (tests, local runs) do we pick a
    scratch folder of our own, and only where driver and executors are one
    machine (a ``local`` master); elsewhere it is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local_dir = tempfile.mkdtemp(prefix="ledgerscope-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for written tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def materialize(df):
    """Cut the lineage of a frame that later steps read several times:
    a reliable checkpoint into the shared folder named by
    ``spark.checkpoint.dir`` (it survives executor loss; localCheckpoint
    would not)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(spark: SparkSession, *steps: Callable) -> list:
    """Results of steps that don't need each other, run at once: many short jobs of one leave cores to another."""
    with ThreadPool(len(steps)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda step: step()), steps, chunksize=1)
