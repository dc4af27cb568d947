"""Materialise a panel once as a bucketed, sorted table.

Many analyses read the same panel. Written with ``bucketBy(customer_id)``
and ``sortBy(customer_id, date)``, the table carries its partitioning in
the catalog: every later per-customer window, aggregate or join reads it
without an exchange (and, with one file per bucket, without a sort). The
files live in the shared folder (``spark.checkpoint.dir``) as an external
table, never on a machine-local path of the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.session import shared_dir
from ledgerscope.sources.ledger import expand_runs


def save_table(df: DataFrame, name: str, key: str = "customer_id", sort: tuple[str, ...] = ("customer_id",),
               buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` written once as a bucketed, sorted table and read back.

    Every call takes a table name and a folder of its own (``name`` and a
    random suffix), so runs on one cluster never overwrite each other.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _write(df.repartition(n, key), name, key, sort, n, path)


def _write(df: DataFrame, name: str, key: str, sort: tuple[str, ...], n: int, path: str | None, **options) -> DataFrame:
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    (df.write.options(**options).bucketBy(n, key).sortBy(*sort)
     .option("path", path or shared_dir(spark, f"tables/{own}"))
     .saveAsTable(own))
    return spark.table(own)


# days that follow each other take no room as differences
DAYS_AS_DIFFERENCES = {"parquet.writer.version": "v2", "parquet.enable.dictionary#date": "false"}
BUCKET_ROWS = 2_000_000     # days per bucket, so that sorting one stays in memory


def panel_buckets(spark: SparkSession, rows: int) -> int:
    """Number of buckets of a panel of about ``rows`` days; it grows with them, so that no bucket is spilled."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def save_runs_as_panel(runs: DataFrame, rows: int, name: str = "ledgerscope_panel", path: str | None = None,
                       dealt: bool = False) -> DataFrame:
    """The daily panel of ``runs`` (about ``rows`` days) as ``save_panel_table`` writes it.

    Runs are dealt to the buckets (``dealt``: they lie in ``panel_buckets`` partitions by customer already) and sorted before they are written out as days, so no day is
    shuffled and the writer's own sort finds the days in order.
    """
    n = panel_buckets(runs.sparkSession, rows)
    runs = (runs if dealt else runs.repartition(n, "customer_id")).sortWithinPartitions("customer_id", "first_day")
    return _write(expand_runs(runs), name, "customer_id", ("customer_id", "date"), n, path, **DAYS_AS_DIFFERENCES)


def save_panel_table(panel: DataFrame, name: str = "ledgerscope_panel",
                     buckets: int | None = None, path: str | None = None) -> DataFrame:
    return save_table(panel, name, sort=("customer_id", "date"), buckets=buckets, path=path)


