"""Queries: forecasts and alerts under a stress shock.

Every (customer, shock) pair is a series of its own and every (segment,
shock) pair a forecast of its own, so one plan serves a whole shock list.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators import forecast as FC
from ledgerscope.operators import runs as R
from ledgerscope.operators import segments as G
from ledgerscope.operators import windows as W
from ledgerscope.plans import q_forecast as QF
from ledgerscope.plans import sqlkit as Q
from ledgerscope.plans.registry import register
from ledgerscope.session import materialize
from ledgerscope.sources import ledger as L

SHOCKS = (0, 25)
N = len(SHOCKS)

PANEL = [
    *Q.panel_ctes("lines", name="plain"),
    "shocks AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {s})" for i, s in enumerate(SHOCKS)) + ") t(pos, shock))",
    f"""panel AS (SELECT p.customer_id * {N} + s.pos AS customer_id, p.segment || ':' || s.shock AS segment, p.date,
   CASE WHEN s.shock > 0 AND p.date >= (SELECT max(date) FROM plain) - 30
        THEN p.balance - p.balance * (CAST(s.shock AS DOUBLE) / 100.0) ELSE p.balance END AS balance
  FROM plain p CROSS JOIN shocks s)""",
]
SQL = Q.with_(*PANEL, *QF.SERIES[len(QF.LINES):], *QF.HOLT, *QF.SES, QF.TAIL, QF.HZ, QF.POINT, QF.CHAIN, QF.SCALE,
              QF.FCAST, QF.KPI, QF.ALERTS, recursive=True)
SPLIT = "split_part(segment, ':', 1) AS segment, CAST(split_part(segment, ':', 2) AS INTEGER) AS shock"


def shocked_series(spark, sf, shocks=SHOCKS):
    """Daily score series per segment and shock (the segment carries the shock)."""
    cut = G.shock_cut(L.calendar_bounds(L.line_dates(spark, sf)))
    pos = F.array_position(F.array(*[F.lit(int(s)) for s in shocks]), F.col("shock")) - 1

    def dense(panel):
        grid = G.stress_shock_grid(panel, shocks, cut=cut)
        grid = grid.select((F.col("customer_id") * len(shocks) + pos).alias("customer_id"),
                           F.concat_ws(":", "segment", "shock").alias("segment"), "date", "balance")
        return W.rolling_scores(grid, trim=False)

    scores = R.by_kind(L.line_runs(spark, sf), lambda runs: R.rolling_scores(R.shock_runs(runs, shocks, cut)), dense, W.rolling_rows())
    return materialize(W.mean_by_day(scores).select("segment", "date", "value"))


def split_key(df):
    parts = F.split("segment", ":")
    return df.withColumns({"segment": parts[0], "shock": parts[1].cast("int")})


@register("shocked_forecast", sql=SQL + f"SELECT {SPLIT}, h, ds, yhat, yhat_lower, yhat_upper, model_used FROM fc")
def shocked_forecast(spark, sf):
    return split_key(FC.forecast_all(shocked_series(spark, sf)))


@register("shocked_alerts", sql=SQL + f"""
SELECT {SPLIT}, min_lower, fhs_day1, fhs_day30, declining, severity FROM alerts""")
def shocked_alerts(spark, sf):
    return split_key(FC.detect_alerts(FC.forecast_all(shocked_series(spark, sf))))
