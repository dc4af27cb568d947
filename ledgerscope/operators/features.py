"""Per-customer behavioural features, risk tiers and segment summaries.

``customer_features`` makes ONE ordered pass per customer: the prefix
frame of the hopping windows, extended with whole-series aggregates and a
running maximum, filtered to window-end rows and the last row, then one
``groupBy(customer_id)`` (no exchange: the panel is partitioned by
customer). The per-family functions below (``balance_features``,
``regularity_feature``, ``fhs_window_stats``) compute the same columns
one family at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.expr import clip, exact_avg, half_up, risk_tier, share_pct
from ledgerscope.operators.scores import delta_stats, monthly_close, monthly_delta
from ledgerscope.operators.windows import hopping_scores
from ledgerscope.params import DEFAULT_PARAMS, RiskParams

FEATURES = DEFAULT_PARAMS.feature_columns


def balance_features(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Raw (unrounded) balance features per customer."""
    w = Window.partitionBy("customer_id").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = F.col("balance") - F.lag("balance").over(w)
    rows = panel.select("customer_id", "segment", "date", "balance", d.alias("diff"),
                        F.max("balance").over(run).alias("runmax"))
    return rows.groupBy("customer_id", "segment").agg(
        F.count(F.lit(1)).alias("n"),
        exact_avg("balance", 2).alias("bal_mean"),
        F.stddev_pop("balance").alias("bal_std"),
        F.regr_slope(F.col("balance"), F.unix_date("date").cast("double")).alias("bal_trend"),
        exact_avg(F.abs("diff"), 2).alias("vel_mean"),
        F.max(F.abs("diff")).alias("vel_max"),
        F.avg(F.when(F.col("balance") < 0, 1.0).otherwise(0.0)).alias("pct_negative_days"),
        F.max(F.col("runmax") - F.col("balance")).alias("max_drawdown"),
        exact_avg(F.when(F.col("diff") < 0, -F.col("diff")), 2).alias("avg_expense"))


def regularity_feature(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Raw cv of month-over-month close changes over the full history
    (no cut-off); one delta or none gives 1.0."""
    st = delta_stats(monthly_delta(monthly_close(panel, ("customer_id",), cutoff=False, p=p)))
    return st.select("customer_id", "n_delta",
                     F.when(F.col("n_delta") > 1,
                            F.col("delta_std") / (F.abs("delta_mean") + F.lit(p.eps)))
                     .otherwise(F.lit(1.0)).alias("income_regularity"))


def fhs_window_stats(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """fhs_mean and population fhs_std (0 for a single window)."""
    return window_stats(hopping_scores(panel, p))


def window_stats(h: DataFrame) -> DataFrame:
    """``fhs_window_stats`` of hopping scores already made."""
    return h.groupBy("customer_id").agg(
        exact_avg("fhs", 2).alias("fhs_mean"),
        F.count(F.lit(1)).alias("n_windows"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_pop("fhs")).otherwise(F.lit(0.0)).alias("fhs_std"))


def _features_frame(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Raw features in ONE ordered pass per customer.

    The hopping-window prefix frame is extended with whole-series
    aggregates (window frames over the whole partition, evaluated once per
    customer) and a running maximum; only the window-end rows and the last
    row of each customer survive the filter, and one groupBy (no exchange:
    the panel is partitioned by customer) assembles the feature row.
    """
    from ledgerscope.operators.windows import _prefix_frame, _window_scores
    series = ["customer_id"]
    pref = _prefix_frame(panel, series, runmax=True)
    wd = Window.partitionBy(*series).orderBy(F.col("date").desc())
    head = wd.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dec = "decimal(18,2)"
    neg_d = F.when(F.col("_d") < 0, -F.col("_d"))
    L = p.hop_size
    idx, n = F.col("idx"), F.col("n")
    s = idx - (L - 1)
    hop_end = ((n > L) & (s >= 0) & (F.pmod(s, F.lit(float(p.hop_step))) == 0) & (s < n - L)) \
        | ((n <= L) & (idx == n - 1))
    pref = pref.select(
        "*",
        F.sum(F.col("balance").cast(dec)).over(head).alias("_bal_sum"),
        F.stddev_pop("balance").over(head).alias("_bal_std"),
        F.regr_slope(F.col("balance"), F.unix_date("date").cast("double")).over(head).alias("_slope"),
        F.sum(F.abs("_d").cast(dec)).over(head).alias("_vel_sum"),
        F.max(F.abs("_d")).over(head).alias("_vel_max"),
        F.avg(F.when(F.col("balance") < 0, 1.0).otherwise(0.0)).over(head).alias("_neg_share"),
        F.max(F.col("_runmax") - F.col("balance")).over(head).alias("_dd"),
        F.sum(neg_d.cast(dec)).over(head).alias("_exp_sum"),
        F.count(neg_d).over(head).alias("_exp_n"),
        F.last("_nme_bal").over(head).alias("_me_first"),
        F.col("balance").alias("_y"), F.col("n").alias("_n"),
        F.greatest(s, F.lit(0.0)).cast("bigint").alias("win_start"),
        hop_end.alias("_is_end"), (idx == n - 1).alias("_is_last"))
    carry = ["win_start", "_is_end", "_is_last", "_bal_sum", "_bal_std", "_slope", "_vel_sum",
             "_vel_max", "_neg_share", "_dd", "_exp_sum", "_exp_n", "_me_first", "_y", "_n",
             "_me_cnt", "_q", "_lme_bal", "_is_me"]
    sc = _window_scores(pref, series, L, hop_end | (idx == n - 1), p, extra=carry)
    end = F.col("_is_end")
    last = F.col("_is_last")
    one = [F.max(F.when(last, F.col(c))).alias(c) for c in carry
           if c not in ("win_start", "_is_end", "_is_last", "_is_me")]
    return sc.groupBy("customer_id", "segment").agg(
        exact_avg(F.when(end, F.col("fhs")), 2).alias("fhs_mean"),
        F.count(F.when(end, 1)).alias("n_windows"),
        F.stddev_pop(F.when(end, F.col("fhs"))).alias("_fhs_std"),
        F.max(F.when(last, F.col("_is_me").cast("int"))).alias("_last_is_me"),
        *one)


def customer_features(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """customer_id, segment, the 11 model features, risk_tier, _fhs_mean.

    Rounding happens at the end only; the tier uses the unrounded mean.
    """
    r = _features_frame(panel, p)
    n = F.col("_n").cast("double")
    bal_mean = F.col("_bal_sum").cast("double") / n
    vel_mean = F.try_divide(F.col("_vel_sum").cast("double"), n - 1)
    expense = F.coalesce(F.col("_exp_sum").cast("double") / F.when(F.col("_exp_n") > 0, F.col("_exp_n")),
                         F.lit(1.0))
    runway = clip(bal_mean / (expense + F.lit(p.eps)), 0.0, 365.0)
    cv = F.col("_bal_std") / (F.abs(bal_mean) + F.lit(p.eps))
    # raw regularity over the whole series: closes = month-ends + the last
    # row when it is not one; deltas telescope, squares come from the carry
    me = F.col("_me_cnt")
    k = F.when(me >= 1, me - 1 + F.when(F.col("_last_is_me") == 1, 0).otherwise(1)).otherwise(0)
    s1 = F.col("_y") - F.col("_me_first")
    part = F.col("_y") - F.col("_lme_bal")
    s2 = F.col("_q") + F.coalesce(part * part, F.lit(0.0))
    var = F.greatest(F.try_divide(s2 - F.try_divide(s1 * s1, k), k - 1), F.lit(0.0))
    reg = F.when(k > 1, F.sqrt(var) / (F.abs(F.try_divide(s1, k)) + F.lit(p.eps))).otherwise(F.lit(1.0))
    fhs_std = F.when(F.col("n_windows") > 1, F.col("_fhs_std")).otherwise(F.lit(0.0))
    return r.select(
        "customer_id", "segment",
        half_up(bal_mean, 2).alias("bal_mean"),
        half_up("_bal_std", 2).alias("bal_std"),
        half_up("_slope", 4).alias("bal_trend"),
        half_up(cv, 4).alias("bal_cv"),
        half_up(fhs_std, 4).alias("fhs_std"),
        half_up(reg, 4).alias("income_regularity"),
        half_up(vel_mean, 2).alias("vel_mean"),
        half_up("_vel_max", 2).alias("vel_max"),
        half_up("_neg_share", 4).alias("pct_negative_days"),
        half_up("_dd", 2).alias("max_drawdown"),
        half_up(runway, 2).alias("runway_mean"),
        risk_tier("fhs_mean", p).alias("risk_tier"),
        half_up("fhs_mean", 2).alias("_fhs_mean"))


def feature_projection(features: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """The model inputs only; the leakage column can never pass."""
    cols = list(p.feature_columns)
    if "_fhs_mean" in cols or "fhs_mean" in cols:
        raise ValueError("fhs_mean must not be a model input (label leakage)")
    return features.select("customer_id", *cols)


def tier_distribution(features: DataFrame) -> DataFrame:
    return features.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n_customers"))


def segment_summary(features: DataFrame) -> DataFrame:
    """Per segment: mean and sample std of the (rounded) FHS mean, size and
    tier shares in percent."""
    return features.groupBy("segment").agg(
        half_up(exact_avg("_fhs_mean", 2), 2).alias("mean_fhs"),
        half_up(F.stddev_samp("_fhs_mean"), 2).alias("std_fhs"),
        F.count(F.lit(1)).alias("n_customers"),
        half_up(share_pct(F.col("risk_tier") == "High"), 1).alias("pct_high_risk"),
        half_up(share_pct(F.col("risk_tier") == "Medium"), 1).alias("pct_medium_risk"),
        half_up(share_pct(F.col("risk_tier") == "Low"), 1).alias("pct_low_risk"))
