"""Queries: customer features, tiers, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.functions.expr import half_up
from ledgerscope.operators import features as FT
from ledgerscope.operators import runs as R
from ledgerscope.operators import windows as W
from ledgerscope.plans import sqlkit as Q
from ledgerscope.plans.registry import register
from ledgerscope.sources import ledger as L

ORDERS = Q.panel_ctes("orders")
FEAT = Q.with_(*ORDERS, *Q.feature_ctes())
FEATURE_COLS = ", ".join(FT.FEATURES)


def features(spark, sf):
    """The feature table on the sparse (orders) ledger (lazy), from its runs."""
    return R.customer_features(L.order_runs(spark, sf))


def feature_table(spark, sf):
    """The feature table materialised once (checkpoint in the shared
    folder) for steps that read it several times, as a feature store
    would hold it."""
    from ledgerscope.session import materialize
    return materialize(features(spark, sf))


@register("customer_features", sql=FEAT + "SELECT * FROM features")
def customer_features(spark, sf):
    return features(spark, sf)


@register("feature_projection", sql=FEAT + f"SELECT customer_id, {FEATURE_COLS} FROM features")
def feature_projection(spark, sf):
    return FT.feature_projection(features(spark, sf))


@register("risk_tier", sql=FEAT + "SELECT customer_id, segment, _fhs_mean, risk_tier FROM features")
def risk_tier(spark, sf):
    return features(spark, sf).select("customer_id", "segment", "_fhs_mean", "risk_tier")


@register("tier_distribution", sql=FEAT + """
SELECT risk_tier, count(*) AS n_customers FROM features GROUP BY risk_tier""")
def tier_distribution(spark, sf):
    return FT.tier_distribution(features(spark, sf))


@register("segment_summary", sql=FEAT + f"""
SELECT segment, {Q.hu(Q.exact_avg('_fhs_mean'), 2)} AS mean_fhs,
       {Q.hu('stddev_samp(_fhs_mean)', 2)} AS std_fhs, count(*) AS n_customers,
       {Q.hu(Q.share_pct("risk_tier = 'High'"), 1)} AS pct_high_risk,
       {Q.hu(Q.share_pct("risk_tier = 'Medium'"), 1)} AS pct_medium_risk,
       {Q.hu(Q.share_pct("risk_tier = 'Low'"), 1)} AS pct_low_risk
FROM features GROUP BY segment""")
def segment_summary(spark, sf):
    return FT.segment_summary(features(spark, sf))


# ---- single feature families (each its own per-customer aggregate) ---------

BALANCE = ("customer_id", "segment", "bal_mean", "bal_std", "bal_trend", "vel_mean", "vel_max", "pct_negative_days",
           "max_drawdown", "avg_expense")


def balance_features(spark, sf):
    """Whole-series features from runs; no day is sorted or spilled."""
    return R.by_kind(L.order_runs(spark, sf), lambda runs: R.balance_features(runs).select(*BALANCE),
                     lambda panel: FT.balance_features(panel).select(*BALANCE))


@register("feat_balance_moments", sql=Q.with_(*ORDERS, *Q.feature_ctes()[:2]) + f"""
SELECT customer_id, {Q.hu('bal_mean', 2)} AS bal_mean, {Q.hu('bal_std', 2)} AS bal_std,
       {Q.hu('bal_std / (abs(bal_mean) + 1e-9)', 4)} AS bal_cv FROM fb""")
def feat_balance_moments(spark, sf):
    b = balance_features(spark, sf)
    return b.select("customer_id", half_up("bal_mean", 2).alias("bal_mean"),
                    half_up("bal_std", 2).alias("bal_std"),
                    half_up(F.col("bal_std") / (F.abs("bal_mean") + F.lit(1e-9)), 4).alias("bal_cv"))


@register("feat_bal_trend", sql=Q.with_(*ORDERS, *Q.feature_ctes()[:2]) + f"""
SELECT customer_id, {Q.hu('bal_trend', 4)} AS bal_trend FROM fb""")
def feat_bal_trend(spark, sf):
    b = balance_features(spark, sf)
    return b.select("customer_id", half_up("bal_trend", 4).alias("bal_trend"))


@register("feat_velocity", sql=Q.with_(*ORDERS, *Q.feature_ctes()[:2]) + f"""
SELECT customer_id, {Q.hu('vel_mean', 2)} AS vel_mean, {Q.hu('vel_max', 2)} AS vel_max FROM fb""")
def feat_velocity(spark, sf):
    b = balance_features(spark, sf)
    return b.select("customer_id", half_up("vel_mean", 2).alias("vel_mean"),
                    half_up("vel_max", 2).alias("vel_max"))


@register("feat_pct_negative", sql=Q.with_(*ORDERS, *Q.feature_ctes()[:2]) + f"""
SELECT customer_id, {Q.hu('pct_negative_days', 4)} AS pct_negative_days FROM fb""")
def feat_pct_negative(spark, sf):
    b = balance_features(spark, sf)
    return b.select("customer_id", half_up("pct_negative_days", 4).alias("pct_negative_days"))


@register("feat_max_drawdown", sql=Q.with_(*ORDERS, *Q.feature_ctes()[:2]) + f"""
SELECT customer_id, {Q.hu('max_drawdown', 2)} AS max_drawdown FROM fb""")
def feat_max_drawdown(spark, sf):
    b = balance_features(spark, sf)
    return b.select("customer_id", half_up("max_drawdown", 2).alias("max_drawdown"))


@register("feat_income_regularity", sql=Q.with_(*ORDERS, *Q.feature_ctes()[2:5]) + f"""
SELECT c.customer_id, {Q.hu('coalesce(r.income_regularity, 1.0)', 4)} AS income_regularity
FROM (SELECT DISTINCT customer_id FROM panel) c LEFT JOIN freg r ON r.customer_id = c.customer_id""")
def feat_income_regularity(spark, sf):
    panel = L.order_panel(spark, sf)
    ids = panel.select("customer_id").distinct()
    r = FT.regularity_feature(panel)
    return ids.join(r, "customer_id", "left").select(
        "customer_id", half_up(F.coalesce("income_regularity", F.lit(1.0)), 4).alias("income_regularity"))


@register("feat_runway", sql=Q.with_(*ORDERS, *Q.feature_ctes()[:2]) + f"""
SELECT customer_id, {Q.hu(Q.clip('bal_mean / (coalesce(avg_expense, 1.0) + 1e-9)', 0.0, 365.0), 2)}
       AS runway_mean FROM fb""")
def feat_runway(spark, sf):
    b = balance_features(spark, sf)
    from ledgerscope.functions.expr import clip
    r = clip(F.col("bal_mean") / (F.coalesce("avg_expense", F.lit(1.0)) + F.lit(1e-9)), 0.0, 365.0)
    return b.select("customer_id", half_up(r, 2).alias("runway_mean"))


@register("feat_fhs_windows", sql=FEAT + f"""
SELECT customer_id, {Q.hu('fhs_mean', 2)} AS fhs_mean, {Q.hu('fhs_std', 4)} AS fhs_std,
       n_windows FROM fh""")
def feat_fhs_windows(spark, sf):
    h = FT.window_stats(R.by_kind(L.order_runs(spark, sf), R.plain_hopping_scores, W.hopping_scores))
    return h.select("customer_id", half_up("fhs_mean", 2).alias("fhs_mean"),
                    half_up("fhs_std", 4).alias("fhs_std"), "n_windows")
