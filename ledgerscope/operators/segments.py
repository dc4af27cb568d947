"""Segment-level views: heatmap, shocks, scenario comparison, KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.expr import exact_avg, half_up, risk_label
from ledgerscope.operators.scores import customer_scores
from ledgerscope.params import DEFAULT_PARAMS, RiskParams

PARTS = ("balance_trend", "income_regularity", "spending_volatility", "debt_ratio")


def heatmap_from_scores(scores: DataFrame, keys=("segment",),
                        p: RiskParams = DEFAULT_PARAMS, counts: bool = False) -> DataFrame:
    """Mean of per-customer scores per segment (and the number of customers with ``counts``).

    The composite is averaged unrounded, rounded to 2 dp for display and
    labelled on the unrounded mean; sub-score means are rounded to 1 dp.
    """
    keys = list(keys)
    # sub-scores carry 2 decimals and the composite 3: exact sums
    agg = scores.groupBy(*keys).agg(
        exact_avg("fhs_raw", 3).alias("_fhs"),
        *[exact_avg(c, 2).alias(f"_{c}") for c in PARTS],
        F.count(F.lit(1)).alias("n_customers"))
    return agg.select(
        *keys, *(["n_customers"] if counts else []),
        half_up("_fhs", 2).alias("fhs"),
        risk_label("_fhs", p).alias("risk_label"),
        *[half_up(f"_{c}", 1).alias(c) for c in PARTS])


def segment_heatmap(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """segment, fhs, risk_label, four sub-score means; ascending fhs."""
    return heatmap_from_scores(customer_scores(panel, p), p=p).orderBy("fhs", "segment")


def shock_cut(bounds: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """One-row cut date from the ledger's calendar bounds; it saves a second build of the panel."""
    return bounds.select(F.date_sub("d_end", p.shock_days).alias("_cut"))


def _cut_of(panel: DataFrame, cut: DataFrame | None, p: RiskParams) -> DataFrame:
    return F.broadcast(cut if cut is not None else panel.agg(F.date_sub(F.max("date"), p.shock_days).alias("_cut")))


def stress_shock(panel: DataFrame, shock_pct, p: RiskParams = DEFAULT_PARAMS,
                 cut: DataFrame | None = None) -> DataFrame:
    """balance -= balance * shock/100 on the last 31 days of the panel.

    The cut date is the global max date minus 30 days (a one-row aggregate
    broadcast to every task). shock <= 0 leaves the panel unchanged. A
    negative balance moves toward zero, as in the reference.
    """
    shock = float(shock_pct)
    if shock <= 0:
        return panel
    bal = F.col("balance")
    return (panel.crossJoin(_cut_of(panel, cut, p))
            .withColumn("balance", F.when(F.col("date") >= F.col("_cut"),
                                          bal - bal * F.lit(shock / 100.0)).otherwise(bal))
            .drop("_cut"))


def stress_shock_grid(panel: DataFrame, shocks, p: RiskParams = DEFAULT_PARAMS,
                      cut: DataFrame | None = None) -> DataFrame:
    """One pass for several shocks: adds ``shock`` (INT) and a shocked balance.

    The shock list is a literal array (size fixed by the caller) exploded
    per row; the panel is read once.
    """
    shocks = [int(s) for s in shocks]
    bal = F.col("balance")
    s = F.col("shock")
    return (panel.crossJoin(_cut_of(panel, cut, p))
            .withColumn("shock", F.explode(F.array(*[F.lit(x) for x in shocks])))
            .withColumn("balance", F.when((s > 0) & (F.col("date") >= F.col("_cut")),
                                          bal - bal * (s.cast("double") / F.lit(100.0)))
                        .otherwise(bal))
            .drop("_cut"))


def shocked_heatmaps(panel: DataFrame, shocks, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Heatmap per (shock, segment) in one job."""
    grid = stress_shock_grid(panel, shocks, p)
    # a series is now (customer_id, shock); customer_id leads so the
    # panel's hash partitioning by customer still satisfies every window
    sc = customer_scores(grid, p, keys=("customer_id", "shock", "segment"),
                         series=("customer_id", "shock"))
    return heatmap_from_scores(sc, keys=("shock", "segment"), p=p)


def scenario_comparison(shocked: DataFrame, baseline: DataFrame) -> DataFrame:
    """segment, baseline_fhs, shocked_fhs, delta, direction (inner join)."""
    b = baseline.select("segment", F.col("fhs").alias("baseline_fhs"))
    s = shocked.select("segment", F.col("fhs").alias("shocked_fhs"), "risk_label")
    j = s.join(b, "segment")
    delta = F.col("shocked_fhs") - F.col("baseline_fhs")
    return j.select(
        "segment", "baseline_fhs", "shocked_fhs", "risk_label",
        half_up(delta, 2).alias("delta"),
        F.when(delta < -2, "negative").when(delta > 2, "positive")
        .otherwise("neutral").alias("direction"))


def portfolio_kpis(scores: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Segments per label plus the real number of customers, from one build of the customer scores."""
    return heatmap_from_scores(scores, p=p, counts=True).agg(
        F.count_if(F.col("risk_label") == "RED").cast("bigint").alias("critical"),
        F.count_if(F.col("risk_label") == "AMBER").cast("bigint").alias("warning"),
        F.count_if(F.col("risk_label") == "GREEN").cast("bigint").alias("healthy"),
        F.coalesce(F.sum("n_customers"), F.lit(0)).alias("total_customers")) \
        .withColumn("action_required", F.col("critical"))


# ---- one-pass shock grid ------------------------------------------------------
#
# A shock multiplies the balances dated on or after the cut date by
# f = 1 - shock/100. Every whole-series moment the scores need is linear
# in the pre-cut and post-cut parts, so one aggregate per customer, split at
# the cut, gives the scores of any number of shocks in closed form:
#   sum y'      = A_y + f B_y           sum x y' = A_xy + f B_xy
#   diffs       : pre-cut diffs as is, the boundary diff f y_c - y_(c-1),
#                 post-cut diffs times f
#   negatives   : unchanged for f > 0
# Regularity reads monthly closes (about 1/30 of the panel), scaled per
# shock where the close lies on or after the cut; with a 30-day cut-off and
# a complete panel no kept close is shocked, so it equals the baseline.

def _split_moments(panel: DataFrame, cut, keys=("customer_id", "segment")) -> DataFrame:
    from pyspark.sql import Window
    keys = list(keys)
    w = Window.partitionBy("customer_id").orderBy("date")
    x = F.datediff("date", "_cut").cast("double")
    rows = panel.crossJoin(cut).select(
        *keys, "date", "balance", "_cut", x.alias("x"),
        (F.col("balance") - F.lag("balance").over(w)).alias("d"),
        F.lag("balance").over(w).alias("prev"))
    pre = F.col("date") < F.col("_cut")
    post = ~pre
    first_post = post & (F.col("prev").isNull() | (F.lag("date").over(w) < F.col("_cut")))
    rows = rows.withColumn("_fp", first_post)
    y, d = F.col("balance"), F.col("d")

    def s(cond, v):
        return F.sum(F.when(cond, v))

    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.coalesce(s(pre, y), F.lit(0.0)).alias("a_y"), F.coalesce(s(post, y), F.lit(0.0)).alias("b_y"),
        F.coalesce(s(pre, F.col("x") * y), F.lit(0.0)).alias("a_xy"),
        F.coalesce(s(post, F.col("x") * y), F.lit(0.0)).alias("b_xy"),
        F.coalesce(s(pre & d.isNotNull(), d), F.lit(0.0)).alias("a_d"),
        F.coalesce(s(pre & d.isNotNull(), d * d), F.lit(0.0)).alias("a_d2"),
        F.coalesce(s(post & ~F.col("_fp"), d), F.lit(0.0)).alias("b_d"),
        F.coalesce(s(post & ~F.col("_fp"), d * d), F.lit(0.0)).alias("b_d2"),
        F.count(d).alias("n_diff"),
        F.max_by(F.when(F.col("_fp"), y), F.col("_fp").cast("int")).alias("y_c"),
        F.max_by(F.when(F.col("_fp"), F.col("prev")), F.col("_fp").cast("int")).alias("y_cm1"),
        F.count_if(pre & (y < 0)).alias("neg_pre"),
        F.count_if(post & (y < 0)).alias("neg_post"),
        F.count_if(post & (y > 0)).alias("pos_post"))


def shocked_heatmaps_fast(panel: DataFrame, shocks, p: RiskParams = DEFAULT_PARAMS,
                          cut: DataFrame | None = None) -> DataFrame:
    """Same result as ``shocked_heatmaps`` without copying the panel per
    shock: one split aggregate per customer, then closed forms."""
    from pyspark.sql import Window
    cut = _cut_of(panel, cut, p)
    wall = Window.partitionBy("customer_id")
    kept = (panel.withColumn("_n", F.count(F.lit(1)).over(wall))
            .withColumn("_dmax", F.max("date").over(wall))
            .where((F.col("_n") <= p.regularity_min_rows)
                   | (F.col("date") < F.date_sub("_dmax", p.regularity_cutoff_days))))
    closes = (kept.groupBy("customer_id", F.trunc("date", "month").alias("month"))
              .agg(F.max_by("balance", "date").alias("close"), F.max("date").alias("close_date")))
    return heatmaps_of_moments(_split_moments(panel, cut), closes, shocks, cut, p)


def heatmaps_of_moments(mom: DataFrame, closes: DataFrame, shocks, cut: DataFrame,
                        p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Heatmap per (shock, segment) from the moments split at the cut and the monthly closes of each customer."""
    from ledgerscope.functions.expr import clip, exp_decay
    from ledgerscope.operators.scores import (
        composite_raw, composite_score, delta_stats, regularity_score)
    from pyspark.sql import Window
    shocks = [int(s) for s in shocks]
    grid = F.explode(F.array(*[F.lit(x) for x in shocks])).alias("shock")
    g = mom.select("*", grid)
    f = F.when(F.col("shock") > 0, F.lit(1.0) - F.col("shock").cast("double") / F.lit(100.0)).otherwise(F.lit(1.0))
    n = F.col("n").cast("double")
    sy = F.col("a_y") + f * F.col("b_y")
    sxy = F.col("a_xy") + f * F.col("b_xy")
    den = n * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(den > 0, F.try_divide(n * sxy - F.col("sx") * sy, den))
    bd = F.when(F.col("y_c").isNotNull() & F.col("y_cm1").isNotNull(),
                f * F.col("y_c") - F.col("y_cm1")).otherwise(F.lit(0.0))
    sd = F.col("a_d") + bd + f * F.col("b_d")
    sd2 = F.col("a_d2") + bd * bd + f * f * F.col("b_d2")
    k = F.col("n_diff").cast("double")
    var = F.greatest(F.try_divide(sd2 - F.try_divide(sd * sd, k), k - 1), F.lit(0.0))
    vol = (F.when(F.col("n_diff") == 0, F.lit(p.neutral_score))
           .when(F.col("n_diff") == 1, F.lit(None).cast("double"))
           .otherwise(half_up(exp_decay(F.sqrt(var) / (F.abs(sy / n) + F.lit(p.eps)), p.volatility_decay), 2)))
    neg = F.col("neg_pre") + F.when(f > 0, F.col("neg_post")).when(f < 0, F.col("pos_post")).otherwise(0)
    debt = half_up(clip(F.lit(100.0) - F.lit(p.debt_factor) * (neg / n)), 2)
    trend = half_up(clip((slope + F.lit(p.trend_offset)) / F.lit(p.trend_divisor)), 2)
    parts = g.select("customer_id", "segment", "shock", trend.alias("balance_trend"),
                     vol.alias("spending_volatility"), debt.alias("debt_ratio"))
    # regularity on monthly closes, shocked per shock where on/after the cut
    sc = closes.crossJoin(cut).select("customer_id", "month", "close", "close_date", "_cut", grid)
    hit = (F.col("shock") > 0) & (F.col("close_date") >= F.col("_cut"))
    sc = sc.withColumn("close", F.when(hit, F.col("close") - F.col("close") * (F.col("shock").cast("double") / F.lit(100.0)))
                       .otherwise(F.col("close")))
    wm = Window.partitionBy("customer_id", "shock").orderBy("month")
    deltas = (sc.select("customer_id", "shock", "month",
                        F.when(F.add_months(F.lag("month").over(wm), 1) == F.col("month"),
                               F.col("close") - F.lag("close").over(wm)).alias("delta"))
              .where(F.col("delta").isNotNull()))
    reg = delta_stats(deltas, ("customer_id", "shock"))
    # one row per customer holding its per-shock stats (bounded by the
    # number of shocks): the join key is customer_id alone, so both sides
    # keep the panel's partitioning and nothing is re-shuffled
    reg = reg.groupBy("customer_id").agg(F.collect_list(
        F.struct("shock", "n_delta", "delta_std", "delta_mean")).alias("_reg"))
    pick = F.try_element_at(F.filter("_reg", lambda r: r["shock"] == F.col("shock")), F.lit(1))
    j = (parts.join(reg, "customer_id", "left")
         .select("*", pick["n_delta"].alias("n_delta"), pick["delta_std"].alias("delta_std"),
                 pick["delta_mean"].alias("delta_mean"))
         .select("customer_id", "segment", "shock", "balance_trend",
                 regularity_score(p=p).alias("income_regularity"), "spending_volatility", "debt_ratio"))
    j = j.select("*", composite_score(p=p).alias("fhs"), composite_raw(p=p).alias("fhs_raw"))
    return heatmap_from_scores(j, keys=("shock", "segment"), p=p)
