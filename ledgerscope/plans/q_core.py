"""Queries: sources, panel, score primitives, segment views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators import runs as R
from ledgerscope.plans import sqlkit as Q
from ledgerscope.plans.registry import register
from ledgerscope.sources import ledger as L

LINES = Q.panel_ctes("lines")
SCORES = Q.score_ctes()


@register("ledger_to_panel", sql=Q.with_(*LINES) + "SELECT * FROM panel")
def ledger_to_panel(spark, sf):
    return L.line_panel(spark, sf)


@register("panel_profile", sql=Q.with_(*LINES) + """
SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers,
       count(DISTINCT segment) AS n_segments, min(date) AS first_date, max(date) AS last_date
FROM panel""")
def panel_profile(spark, sf):
    p = L.line_panel(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.countDistinct("customer_id").alias("n_customers"),
                 F.countDistinct("segment").alias("n_segments"),
                 F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@register("customer_fhs", sql=Q.with_(*LINES, *SCORES) + """
SELECT customer_id, segment, balance_trend, income_regularity, spending_volatility,
       debt_ratio, fhs FROM scores""")
def customer_fhs(spark, sf):
    return R.customer_scores(L.line_runs(spark, sf)).drop("fhs_raw")


@register("segment_heatmap", sql=Q.with_(*LINES, *SCORES, Q.heatmap_cte()) + """
SELECT * FROM heatmap ORDER BY fhs, segment""")
def segment_heatmap(spark, sf):
    return R.segment_heatmap(L.line_runs(spark, sf))
