"""Per-series score primitives and the composite financial health score.

A series is one customer's rows of a complete daily panel. All scores are
aggregates over ``groupBy(customer_id)``; because the panel arrives
hash-partitioned by customer, none of them adds an exchange.

Conventions (kept from the reference definition):
* trend      : OLS slope of balance on the day index, clip((s+500)/10).
* regularity : month-end closes (last row of each calendar month) after
               dropping the last 30 days when the series has > 60 rows;
               deltas only between adjacent calendar months; sample std
               over |mean|; no delta -> 50; one delta -> NULL.
* volatility : sample std of daily diffs over |mean balance|; no diff -> 50.
* debt       : 100 - 200 * share of negative days.
* composite  : weights over the sub-scores already rounded to 2 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.expr import clip, exp_decay, half_up
from ledgerscope.params import DEFAULT_PARAMS, RiskParams

KEY = ["customer_id", "segment"]


def _w(keys):
    return Window.partitionBy(*keys).orderBy("date")


def series_moments(panel: DataFrame, keys=KEY, series=("customer_id",)) -> DataFrame:
    """Per series: n, slope, diff std/count, mean, share negative."""
    keys = list(keys)
    w = _w(list(series))
    base = panel.select(*keys, "date", "balance",
                        (F.col("balance") - F.lag("balance").over(w)).alias("diff"))
    return base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(F.col("balance"), F.unix_date("date").cast("double")).alias("slope"),
        F.stddev_samp("diff").alias("diff_std"),
        F.count("diff").alias("n_diff"),
        F.avg("balance").alias("bal_mean"),
        F.avg(F.when(F.col("balance") < 0, 1.0).otherwise(0.0)).alias("pct_negative"),
    )


def monthly_close(panel: DataFrame, keys=("customer_id",), cutoff: bool = False,
                  p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Last balance of each calendar month: keys, month (DATE), close.

    With ``cutoff`` the rows on or after ``max(date) - 30 days`` of each
    series are dropped first, when the series has more than 60 rows.
    """
    keys = list(keys)
    src = panel
    if cutoff:
        wall = Window.partitionBy(*keys)
        src = (panel.withColumn("_n", F.count(F.lit(1)).over(wall))
               .withColumn("_dmax", F.max("date").over(wall))
               .where((F.col("_n") <= p.regularity_min_rows)
                      | (F.col("date") < F.date_sub("_dmax", p.regularity_cutoff_days))))
    return (src.groupBy(*keys, F.trunc("date", "month").alias("month"))
            .agg(F.max_by("balance", "date").alias("close")))


def monthly_delta(closes: DataFrame, keys=("customer_id",)) -> DataFrame:
    """close - previous close, kept only when the previous month is adjacent."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("month")
    prev_m = F.lag("month").over(w)
    prev_c = F.lag("close").over(w)
    return (closes.select(*keys, "month", "close",
                          F.when(F.add_months(prev_m, 1) == F.col("month"),
                                 F.col("close") - prev_c).alias("delta"))
            .where(F.col("delta").isNotNull()))


def delta_stats(deltas: DataFrame, keys=("customer_id",)) -> DataFrame:
    return deltas.groupBy(*keys).agg(
        F.count("delta").alias("n_delta"),
        F.stddev_samp("delta").alias("delta_std"),
        F.avg("delta").alias("delta_mean"))


# ---- score expressions over the moment columns ---------------------------

def trend_score(slope="slope", p: RiskParams = DEFAULT_PARAMS):
    s = F.col(slope) if isinstance(slope, str) else slope
    return half_up(clip((s + F.lit(p.trend_offset)) / F.lit(p.trend_divisor)), 2)


def regularity_score(n="n_delta", sd="delta_std", mean="delta_mean",
                     p: RiskParams = DEFAULT_PARAMS):
    cv = F.col(sd) / (F.abs(F.col(mean)) + F.lit(p.eps))
    return (F.when(F.coalesce(F.col(n), F.lit(0)) == 0, F.lit(p.neutral_score))
            .otherwise(half_up(exp_decay(cv, p.regularity_decay), 2)))


def volatility_score(n="n_diff", sd="diff_std", mean="bal_mean",
                     p: RiskParams = DEFAULT_PARAMS):
    rel = F.col(sd) / (F.abs(F.col(mean)) + F.lit(p.eps))
    return (F.when(F.col(n) == 0, F.lit(p.neutral_score))
            .otherwise(half_up(exp_decay(rel, p.volatility_decay), 2)))


def debt_score(share="pct_negative", p: RiskParams = DEFAULT_PARAMS):
    return half_up(clip(F.lit(100.0) - F.lit(p.debt_factor) * F.col(share)), 2)


def composite_raw(t="balance_trend", r="income_regularity", v="spending_volatility",
                  d="debt_ratio", p: RiskParams = DEFAULT_PARAMS):
    return (F.lit(p.w_trend) * F.col(t) + F.lit(p.w_regularity) * F.col(r)
            + F.lit(p.w_volatility) * F.col(v) + F.lit(p.w_debt) * F.col(d))


def composite_score(p: RiskParams = DEFAULT_PARAMS, **cols):
    return half_up(clip(composite_raw(p=p, **cols)), 2)


def customer_scores(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS,
                    keys=KEY, series=("customer_id",)) -> DataFrame:
    """keys + balance_trend, income_regularity, spending_volatility,
    debt_ratio, fhs (rounded, 2 dp) and fhs_raw (unrounded composite).

    ``series`` are the columns that identify one series (window partition);
    ``keys`` are the output keys (series columns plus attributes such as
    the segment). Both lead with customer_id so that the panel's
    partitioning is reused.
    """
    keys, series = list(keys), list(series)
    mom = series_moments(panel, keys, series)
    reg = delta_stats(monthly_delta(monthly_close(panel, series, cutoff=True, p=p),
                                    series), series)
    j = mom.join(reg, series, "left")
    scored = j.select(
        *keys,
        trend_score(p=p).alias("balance_trend"),
        regularity_score(p=p).alias("income_regularity"),
        volatility_score(p=p).alias("spending_volatility"),
        debt_score(p=p).alias("debt_ratio"))
    return scored.select(
        "*",
        composite_score(p=p).alias("fhs"),
        composite_raw(p=p).alias("fhs_raw"))
