"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerscope.session import shared_dir


# A batch of rows on its way to a Python worker. Spark's own bound is 64 MB, held several times over by each running task.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most ``BATCH_BYTES`` (or one longer row), so memory does not follow the texts' lengths."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) != str(BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: later steps read files that every executor can see, so
    a lost executor costs only its running tasks. Each call takes a folder of
    its own.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast ``value`` with the classes it needs; the result gives it back inside a task.

    Executors then need no copy of this package on their path.
    """
    bound_batches(spark)
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


def with_fields(schema: StructType, more: str) -> StructType:
    """``schema`` with further fields given as DDL; field names may hold any character."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])
