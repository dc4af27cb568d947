"""Queries: window operators and windowed score series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators import runs as R
from ledgerscope.operators import windows as W
from ledgerscope.plans import sqlkit as Q
from ledgerscope.plans.registry import register
from ledgerscope.sources import ledger as L

LINES = Q.panel_ctes("lines")

# brute force: every (customer, end) window materialised by a range join
ROLL_WIN = [
    "ends AS (SELECT DISTINCT date AS end_date FROM panel WHERE date > (SELECT max(date) FROM panel) - 45)",
    """rwin AS (SELECT p.customer_id, e.end_date, p.segment, p.date, p.balance
  FROM ends e JOIN panel p ON p.date BETWEEN e.end_date - 180 AND e.end_date)""",
]
ROLL_SCORES = Q.score_ctes("rwin", keys="customer_id, end_date, segment",
                           series="customer_id, end_date", name="rs")

HOP_WIN = Q.HOP_WIN
HOP_SCORES = Q.score_ctes("hwin", keys="customer_id, win_start, segment",
                          series="customer_id, win_start", name="hs")


@register("rolling_daily_fhs", sql=Q.with_(*LINES, *ROLL_WIN, *ROLL_SCORES) + f"""
SELECT segment, end_date AS date, round({Q.exact_avg('fhs')}, 6) AS value, count(*) AS n_customers
FROM rs GROUP BY segment, end_date""")
def rolling_daily_fhs(spark, sf):
    return R.rolling_daily_fhs(L.line_runs(spark, sf)).withColumn("value", F.round("value", 6))


@register("hopping_fhs", sql=Q.with_(*LINES, *HOP_WIN, *HOP_SCORES) + """
SELECT customer_id, segment, win_start, balance_trend, income_regularity,
       spending_volatility, debt_ratio, fhs FROM hs""")
def hopping_fhs(spark, sf):
    return (R.hopping_scores(L.line_runs(spark, sf))
            .select("customer_id", "segment", "win_start", "balance_trend", "income_regularity",
                    "spending_volatility", "debt_ratio", "fhs"))
