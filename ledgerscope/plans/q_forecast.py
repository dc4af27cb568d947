"""Queries: forecasters, intervals, backtest, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.functions.expr import half_up
from ledgerscope.operators import forecast as FC
from ledgerscope.operators import runs as R
from ledgerscope.plans import sqlkit as Q
from ledgerscope.plans.q_windows import LINES, ROLL_SCORES, ROLL_WIN
from ledgerscope.plans.registry import register
from ledgerscope.session import materialize
from ledgerscope.sources import ledger as L

SEGMENT_VIEW = "BUILDING"   # the segment shown by the single-series view

SERIES = [
    *LINES, *ROLL_WIN, *ROLL_SCORES,
    f"series AS (SELECT segment, end_date AS date, {Q.exact_avg('fhs')} AS value FROM rs GROUP BY segment, end_date)",
    """ser AS (SELECT segment, date, value, row_number() OVER (PARTITION BY segment ORDER BY date) AS t,
   count(*) OVER (PARTITION BY segment) AS n FROM series)""",
    Q.grid_cte(),
]
HOLT = Q.holt_ctes("ser", "holt")
SES = Q.ses_ctes("ser", "ses")
TAIL = Q.tail_stats_cte("ser", "tl")
HZ = "hz AS (SELECT CAST(h AS BIGINT) AS h FROM range(1, 31) t(h))"
POINT = f"""pf AS (SELECT tl.segment, hz.h, CAST(tl.last_date + CAST(hz.h AS INTEGER) AS DATE) AS ds,
   hb.level + CAST(hz.h AS DOUBLE) * hb.trend AS yhat_holt,
   sb.level + sb.bias + CAST(hz.h AS DOUBLE) * tl.slope30 AS yhat_ses,
   sb.level AS yhat_ses_flat,
   tl.icpt30 + tl.slope30 * (tl.m30 - 1 + CAST(hz.h AS DOUBLE)) AS yhat_linear,
   tl.last_value AS yhat_naive, tl.sma AS yhat_sma
  FROM tl CROSS JOIN hz LEFT JOIN holt_best hb ON hb.segment = tl.segment
  LEFT JOIN ses_best sb ON sb.segment = tl.segment)"""
CHAIN = """fcr AS (SELECT *, CASE WHEN yhat_holt IS NOT NULL AND NOT isnan(yhat_holt) THEN yhat_holt
     WHEN yhat_ses IS NOT NULL AND NOT isnan(yhat_ses) THEN yhat_ses ELSE yhat_linear END AS yhat_raw,
   CASE WHEN yhat_holt IS NOT NULL AND NOT isnan(yhat_holt) THEN 'holt'
     WHEN yhat_ses IS NOT NULL AND NOT isnan(yhat_ses) THEN 'ses' ELSE 'linear' END AS model_used FROM pf)"""
SCALE = """rsd AS (SELECT segment, CASE WHEN s IS NULL OR isnan(s) OR s < 0.5 THEN 2.0 ELSE s END AS resid_std
  FROM (SELECT segment, stddev_pop(d) AS s FROM
        (SELECT segment, value - lag(value) OVER (PARTITION BY segment ORDER BY date) AS d FROM series)
        GROUP BY segment))"""
YH = Q.clip("f.yhat_raw")
MARGIN = "1.96 * r.resid_std * sqrt(CAST(f.h AS DOUBLE))"
FCAST = f"""fc AS (SELECT f.segment, f.h, f.ds, f.model_used, r.resid_std,
   {Q.hu(YH, 2)} AS yhat,
   {Q.hu(Q.clip(f'{YH} - {MARGIN}'), 2)} AS yhat_lower,
   {Q.hu(Q.clip(f'{YH} + {MARGIN}'), 2)} AS yhat_upper
  FROM fcr f JOIN rsd r ON r.segment = f.segment)"""
ALL = Q.with_(*SERIES, *HOLT, *SES, TAIL, HZ, POINT, CHAIN, SCALE, FCAST, recursive=True)


def series(spark, sf):
    """Daily scores of the segments: a few hundred rows that every model reads, so they are computed once."""
    return materialize(R.rolling_daily_fhs(L.line_runs(spark, sf)).select("segment", "date", "value"))


def point(spark, sf):
    return FC.point_forecasts(series(spark, sf))


def fcast(spark, sf):
    return FC.forecast_all(series(spark, sf))


@register("forecast_naive", sql=ALL + f"SELECT segment, h, {Q.hu('yhat_naive', 4)} AS yhat FROM pf")
def forecast_naive(spark, sf):
    return point(spark, sf).select("segment", "h", half_up("yhat_naive", 4).alias("yhat"))


@register("forecast_sma", sql=ALL + f"SELECT segment, h, {Q.hu('yhat_sma', 4)} AS yhat FROM pf")
def forecast_sma(spark, sf):
    return point(spark, sf).select("segment", "h", half_up("yhat_sma", 4).alias("yhat"))


@register("forecast_holt", sql=ALL + f"""
SELECT p.segment, p.h, hb.alpha, hb.beta, {Q.hu('p.yhat_holt', 4)} AS yhat
FROM pf p JOIN holt_best hb ON hb.segment = p.segment""")
def forecast_holt(spark, sf):
    return point(spark, sf).where(F.col("h_alpha").isNotNull()).select(
        "segment", "h", F.col("h_alpha").alias("alpha"), F.col("h_beta").alias("beta"),
        half_up("yhat_holt", 4).alias("yhat"))


@register("forecast_ses_trend", sql=ALL + f"SELECT segment, h, {Q.hu('yhat_ses', 4)} AS yhat FROM pf")
def forecast_ses_trend(spark, sf):
    return point(spark, sf).select("segment", "h", half_up("yhat_ses", 4).alias("yhat"))


@register("forecast_ses_flat", sql=ALL + f"""
SELECT segment, alpha, {Q.hu('level', 4)} AS level FROM ses_best""")
def forecast_ses_flat(spark, sf):
    arrs = FC.as_arrays(series(spark, sf))
    s = FC.ses_fit(arrs)
    return s.select("segment", "alpha", half_up("level", 4).alias("level"))


@register("forecast_linear", sql=ALL + f"SELECT segment, h, {Q.hu('yhat_linear', 4)} AS yhat FROM pf")
def forecast_linear(spark, sf):
    return point(spark, sf).select("segment", "h", half_up("yhat_linear", 4).alias("yhat"))


@register("forecast_fallback_chain", sql=ALL + f"""
SELECT segment, h, {Q.hu('yhat_raw', 4)} AS yhat_raw, model_used FROM fcr""")
def forecast_fallback_chain(spark, sf):
    return FC.fallback_chain(point(spark, sf)).select(
        "segment", "h", half_up("yhat_raw", 4).alias("yhat_raw"), "model_used")


@register("forecast_interval", sql=ALL + f"""
SELECT segment, h, {Q.hu('resid_std', 4)} AS resid_std, yhat, yhat_lower, yhat_upper FROM fc""")
def forecast_interval(spark, sf):
    s = series(spark, sf)
    fc = FC.with_interval(FC.fallback_chain(FC.point_forecasts(s)), FC.residual_scale(s))
    return fc.select("segment", "h", half_up("resid_std", 4).alias("resid_std"),
                     "yhat", "yhat_lower", "yhat_upper")


@register("forecast_all_segments", sql=ALL + """
SELECT segment, h, ds, yhat, yhat_lower, yhat_upper, model_used FROM fc""")
def forecast_all_segments(spark, sf):
    return fcast(spark, sf)


@register("forecast_series_view", sql=ALL + f"""
SELECT segment, 'history' AS kind, date, {Q.hu('value', 2)} AS value FROM series WHERE segment = '{SEGMENT_VIEW}'
UNION ALL
SELECT segment, 'forecast' AS kind, ds AS date, yhat AS value FROM fc WHERE segment = '{SEGMENT_VIEW}'""")
def forecast_series_view(spark, sf, segment: str = SEGMENT_VIEW):
    s = series(spark, sf)
    fc = FC.forecast_all(s)
    hist = s.where(F.col("segment") == segment).select(
        "segment", F.lit("history").alias("kind"), "date", half_up("value", 2).alias("value"))
    fut = fc.where(F.col("segment") == segment).select(
        "segment", F.lit("forecast").alias("kind"), F.col("ds").alias("date"), F.col("yhat").alias("value"))
    return hist.unionByName(fut)


@register("date_axis_align", sql=ALL + f"""
SELECT coalesce(s.segment, f.segment) AS segment, coalesce(s.date, f.ds) AS date,
       {Q.hu('s.value', 2)} AS history, f.yhat, f.yhat_lower, f.yhat_upper
FROM series s FULL OUTER JOIN fc f ON f.segment = s.segment AND f.ds = s.date""")
def date_axis_align(spark, sf):
    s = series(spark, sf)
    fc = FC.forecast_all(s)
    j = s.join(fc.withColumnRenamed("ds", "date"), ["segment", "date"], "full_outer")
    return j.select("segment", "date", half_up("value", 2).alias("history"),
                    "yhat", "yhat_lower", "yhat_upper")


KPI = """kpi AS (SELECT segment, arg_min(yhat, h) AS day1, arg_max(yhat, h) AS day30,
   min(yhat_lower) AS min_lower, max(yhat_upper) AS max_upper, count(*) AS n,
   sum(CASE WHEN h <= 15 THEN yhat END) AS s1, sum(CASE WHEN h > 15 THEN yhat END) AS s2 FROM fc GROUP BY segment)"""
ALERTS = f"""alerts AS (SELECT segment, {Q.hu('min_lower', 1)} AS min_lower, {Q.hu('day1', 1)} AS fhs_day1,
   {Q.hu('day30', 1)} AS fhs_day30, day30 < day1 - 1.0 AS declining,
   CASE WHEN min_lower < 35.0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity
  FROM kpi WHERE min_lower < 35.0 OR day30 < day1 - 1.0)"""
ALL_K = Q.with_(*SERIES, *HOLT, *SES, TAIL, HZ, POINT, CHAIN, SCALE, FCAST, KPI, ALERTS, recursive=True)


def alerts(spark, sf):
    return FC.detect_alerts(fcast(spark, sf))


@register("detect_alerts", sql=ALL_K + "SELECT * FROM alerts")
def detect_alerts(spark, sf):
    return alerts(spark, sf)


@register("sort_alerts", sql=ALL_K + """
SELECT segment, min_lower, severity, row_number() OVER (ORDER BY min_lower, segment) AS alert_rank FROM alerts""")
def sort_alerts(spark, sf):
    from pyspark.sql import Window
    a = alerts(spark, sf)
    # alerts are at most one per segment: a single ordered window is bounded
    return a.select("segment", "min_lower", "severity",
                    F.row_number().over(Window.orderBy("min_lower", "segment")).cast("bigint").alias("alert_rank"))


@register("forecast_kpis", sql=ALL_K + f"""
SELECT segment, day1, day30, {Q.hu('day30 - day1', 2)} AS delta,
       CASE WHEN day30 - day1 >= 0 THEN 'up' ELSE 'down' END AS arrow, min_lower, max_upper FROM kpi""")
def forecast_kpis(spark, sf):
    return FC.forecast_kpis(fcast(spark, sf))


@register("forecast_summary", sql=ALL_K + f"""
SELECT segment, day1, day30, {Q.hu('CASE WHEN day1 = 0 THEN NULL ELSE (day30 - day1) / day1 END * 100.0', 1)} AS pct_change,
   CASE WHEN day30 - day1 >= 0 THEN 'increase' ELSE 'decline' END AS direction,
   {Q.risk_label('day30')} AS day30_label,
   {Q.hu('s1 / floor(n / 2)', 2)} AS first_half_mean, {Q.hu('s2 / (n - floor(n / 2))', 2)} AS second_half_mean,
   CASE WHEN s2 / (n - floor(n / 2)) < s1 / floor(n / 2) - 0.5 THEN 'downtrend'
        WHEN s2 / (n - floor(n / 2)) > s1 / floor(n / 2) + 0.5 THEN 'recovery' ELSE 'none' END AS trend_note
FROM kpi""")
def forecast_summary(spark, sf):
    return FC.forecast_summary(fcast(spark, sf))


# ---- backtest ----------------------------------------------------------------

BT = [
    """bser AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS n_train FROM ser
  WHERE n >= 10 AND n - floor(n * 0.8) >= 3)""",
    "btrain AS (SELECT segment, date, value, t, n_train AS n FROM bser WHERE t <= n_train)",
    "btest AS (SELECT segment, date, value AS actual, t - n_train AS h FROM bser WHERE t > n_train)",
    *Q.holt_ctes("btrain", "bholt"),
    *Q.ses_ctes("btrain", "bses"),
    Q.tail_stats_cte("btrain", "btl"),
    """bpred AS (SELECT x.segment, x.date, x.actual, m.model, m.predicted FROM (
  SELECT e.segment, e.date, e.actual, tl.last_value AS naive, tl.sma AS sma,
    CASE WHEN hb.level IS NOT NULL THEN hb.level + CAST(e.h AS DOUBLE) * hb.trend
         WHEN sb.level IS NOT NULL THEN sb.level ELSE tl.last_value END AS holt_winters
  FROM btest e JOIN btl tl ON tl.segment = e.segment
  LEFT JOIN bholt_best hb ON hb.segment = e.segment LEFT JOIN bses_best sb ON sb.segment = e.segment) x,
  LATERAL (VALUES ('naive', x.naive), ('sma', x.sma), ('holt_winters', x.holt_winters)) m(model, predicted))""",
    f"""bmet AS (SELECT segment, model,
   {Q.hu('sqrt(avg((actual - predicted) * (actual - predicted)))', 4)} AS rmse,
   {Q.hu('avg(abs(actual - predicted))', 4)} AS mae,
   {Q.hu('coalesce(avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100.0, 0.0)', 2)} AS mape,
   count(*) AS n_test
  FROM bpred GROUP BY segment, model)""",
]
ALL_B = Q.with_(*SERIES, *BT, recursive=True)


def metrics(spark, sf):
    return FC.error_metrics(FC.backtest_predictions(series(spark, sf)))


@register("chronological_split", sql=ALL_B + """
SELECT segment, date, t, CASE WHEN t <= n_train THEN 'train' ELSE 'test' END AS split FROM bser""")
def chronological_split(spark, sf):
    return FC.chronological_split(series(spark, sf)).select(
        "segment", "date", F.col("t").cast("bigint").alias("t"), "split")


@register("forecast_backtest", sql=ALL_B + f"""
SELECT segment, model, date, {Q.hu('actual', 4)} AS actual, {Q.hu('predicted', 4)} AS predicted FROM bpred""")
def forecast_backtest(spark, sf):
    b = FC.backtest_predictions(series(spark, sf))
    return b.select("segment", "model", "date", half_up("actual", 4).alias("actual"),
                    half_up("predicted", 4).alias("predicted"))


@register("forecast_error_metrics", sql=ALL_B + "SELECT * FROM bmet")
def forecast_error_metrics(spark, sf):
    return metrics(spark, sf)


@register("backtest_summary", sql=ALL_B + f"""
SELECT CAST(count_if(hw < naive) AS BIGINT) AS hw_wins, count(*) AS n_segments,
       {Q.hu('coalesce(avg(CASE WHEN naive > 0 THEN (naive - hw) / naive * 100.0 END), 0.0)', 1)}
         AS avg_rmse_improvement_pct
FROM (SELECT segment, max(CASE WHEN model = 'naive' THEN rmse END) AS naive,
             max(CASE WHEN model = 'holt_winters' THEN rmse END) AS hw FROM bmet GROUP BY segment)""")
def backtest_summary(spark, sf):
    return FC.backtest_summary(metrics(spark, sf))


@register("best_model_per_segment", sql=ALL_B + """
SELECT segment, model AS best_model, rmse AS best_rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY rmse,
         CASE model WHEN 'holt_winters' THEN 0 WHEN 'sma' THEN 1 ELSE 2 END) AS rk FROM bmet)
WHERE rk = 1""")
def best_model_per_segment(spark, sf):
    return FC.best_model(metrics(spark, sf))
