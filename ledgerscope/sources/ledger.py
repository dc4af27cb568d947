"""Ledgers (dated money flows per customer) and the complete daily panel.

The balance panel contract is ``(customer_id BIGINT, segment STRING,
date DATE, balance DOUBLE)`` with one row per customer and calendar day
and no gaps. The supplied tables hold transactions, so the panel is built
from a ledger:

* ``line_ledger``  : lineitem JOIN orders; flow = net price signed by the
  return flag (R -1, A -0.5, N +1.5), dated by ship date.
* ``order_ledger`` : orders; flow = total price, F +1, O -1, P 0, dated by
  order date (a sparse ledger with flat stretches).

``ledger_to_panel`` never shuffles the dense panel: flows are first summed
per (customer, day) with map-side partial aggregation (a hot customer is
cut down to at most one row per day before the exchange), the change
points are ordered per customer, and each change point is expanded
locally into the run of days until the next one. The output stays
hash-partitioned by ``customer_id``, so every later per-customer window or
aggregate runs without another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.sources.tables import read_table

PANEL_SCHEMA = "customer_id BIGINT, segment STRING, date DATE, balance DOUBLE"
# money is summed exactly; balances become DOUBLE after rounding to cents
AMOUNT = "decimal(18,5)"

# FIXED VALUES (ledger binding of the supplied tables, see SURVEY 7.2)
LINE_SIGN = {"R": -1.0, "A": -0.5, "N": 1.5}
ORDER_SIGN = {"F": 1.0, "O": -1.0, "P": 0.0}


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, segment, opening balance."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("bigint").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast("decimal(15,2)").cast(AMOUNT).alias("opening"),
    )


def line_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, date, amount from lineitem JOIN orders."""
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    sign = (F.when(F.col("l_returnflag") == "R", F.lit(LINE_SIGN["R"]))
            .when(F.col("l_returnflag") == "A", F.lit(LINE_SIGN["A"]))
            .otherwise(F.lit(LINE_SIGN["N"]))).cast("decimal(2,1)")
    net = (F.col("l_extendedprice").cast("decimal(12,2)")
           * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")))
    lines = li.select(
        F.col("l_orderkey"),
        F.to_date("l_shipdate").alias("date"),
        (net * sign).cast(AMOUNT).alias("amount"),
    )
    keys = o.select(F.col("o_orderkey"), F.col("o_custkey").cast("bigint").alias("customer_id"))
    return (lines.join(keys, lines.l_orderkey == keys.o_orderkey)
            .select("customer_id", "date", "amount"))


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, date, amount from orders (status P carries no flow)."""
    o = read_table(spark, sf_dir, "orders")
    sign = (F.when(F.col("o_orderstatus") == "F", F.lit(ORDER_SIGN["F"]))
            .when(F.col("o_orderstatus") == "O", F.lit(ORDER_SIGN["O"]))
            .otherwise(F.lit(ORDER_SIGN["P"])))
    return (o.where(F.col("o_orderstatus").isin("F", "O"))
            .select(F.col("o_custkey").cast("bigint").alias("customer_id"),
                    F.to_date("o_orderdate").alias("date"),
                    (F.col("o_totalprice").cast("decimal(15,2)") * sign.cast("decimal(2,1)"))
                    .cast(AMOUNT).alias("amount")))


def calendar_bounds(dates: DataFrame, days: int | None = None) -> DataFrame:
    """One row: d_start, d_end = first and last date, or the last ``days`` days.

    ``dates`` is any frame with a column ``date`` (for the line ledger a
    one-column scan of lineitem, so the bound does not re-run the join).
    """
    ends = dates.agg(F.to_date(F.min("date")).alias("d_first"), F.to_date(F.max("date")).alias("d_end"))
    start = F.col("d_first") if days is None else F.date_sub("d_end", days - 1)
    return ends.select(start.alias("d_start"), "d_end")


def ledger_to_runs(flows: DataFrame, accts: DataFrame, days: int | None = None,
                   bounds: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Complete daily balances as runs of equal days.

    customer_id, segment, first_day, last_day, balance (cents, as DOUBLE),
    d_start, d_end: a balance is constant between flows, so a customer has one
    row per day with flows, and the runs of a customer cover every day from d_start to
    d_end once. With ``days`` only the last ``days`` days are covered, and
    everything before counts as one opening point. Customers without flows
    have one run; flows of customers without an account row are dropped. Customers
    are dealt to ``parts`` partitions, spark.sql.shuffle.partitions unless given.
    """
    b = F.broadcast(bounds if bounds is not None else calendar_bounds(flows, days))
    moved = (flows.crossJoin(b)
             .where(F.col("date") <= F.col("d_end"))
             .select("customer_id",
                     F.greatest(F.col("date"), F.col("d_start")).alias("date"),
                     F.col("amount")))
    opened = (accts.crossJoin(b)
              .select("customer_id", F.col("d_start").alias("date"),
                      F.col("opening").alias("amount")))
    # map-side partial sums cap every customer at one row per day before
    # the exchange, whatever its share of the flows
    points = (moved.unionByName(opened)
              .groupBy("customer_id", "date")
              .agg(F.sum("amount").alias("net")))
    # the expansion of runs multiplies rows ~days/flows-fold, so its
    # parallelism must not follow the (small) change-point exchange: fix
    # the customer partitioning at spark.sql.shuffle.partitions (AQE never
    # coalesces an explicit repartition). Rows per customer are already
    # capped at one per day here, so this exchange is skew-free.
    n_parts = parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = points.repartition(n_parts, "customer_id")
    w = Window.partitionBy("customer_id").orderBy("date")
    runs = points.select(
        "customer_id", "date",
        F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("bal"),
        F.lead("date").over(w).alias("next_date"))
    # segment by key join: the runs keep their customer partitioning, only
    # the (one row per customer) account side moves, or is broadcast when
    # the planner's size check allows it
    runs = runs.join(accts.select("customer_id", "segment"), "customer_id").crossJoin(b)
    return runs.select(
        "customer_id", "segment", F.col("date").alias("first_day"),
        F.coalesce(F.date_sub("next_date", 1), F.col("d_end")).alias("last_day"),
        F.round("bal", 2).cast("double").alias("balance"), "d_start", "d_end")


def expand_runs(runs: DataFrame, keep_last: int | None = None) -> DataFrame:
    """The daily panel of ``runs``; with ``keep_last`` its trailing days only."""
    first_day = F.col("first_day")
    if keep_last:
        since = F.date_sub("d_end", keep_last - 1)
        runs = runs.where(F.col("last_day") >= since)
        first_day = F.greatest(first_day, since)
    return runs.select(
        "customer_id", "segment",
        F.explode(F.sequence(first_day, F.col("last_day"))).alias("date"), "balance")


def ledger_to_panel(flows: DataFrame, accts: DataFrame, days: int | None = None,
                    bounds: DataFrame | None = None, keep_last: int | None = None) -> DataFrame:
    """Complete daily running balances from the first to the last flow.

    balance(day) = opening + all flows dated on or before that day; see
    ``ledger_to_runs``. With ``keep_last`` only the trailing ``keep_last``
    days are emitted (balances still include all history).
    """
    return expand_runs(ledger_to_runs(flows, accts, days, bounds), keep_last)


def line_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("date"))


def line_panel(spark: SparkSession, sf_dir: str, days: int | None = None,
               keep_last: int | None = None) -> DataFrame:
    return ledger_to_panel(line_ledger(spark, sf_dir), accounts(spark, sf_dir), days,
                           bounds=calendar_bounds(line_dates(spark, sf_dir), days),
                           keep_last=keep_last)


def order_panel(spark: SparkSession, sf_dir: str, days: int | None = None,
                keep_last: int | None = None) -> DataFrame:
    return ledger_to_panel(order_ledger(spark, sf_dir), accounts(spark, sf_dir), days,
                           keep_last=keep_last)


def line_runs(spark: SparkSession, sf_dir: str, days: int | None = None, parts: int | None = None) -> DataFrame:
    return ledger_to_runs(line_ledger(spark, sf_dir), accounts(spark, sf_dir), days,
                          bounds=calendar_bounds(line_dates(spark, sf_dir), days), parts=parts)


def order_runs(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    return ledger_to_runs(order_ledger(spark, sf_dir), accounts(spark, sf_dir), days)
