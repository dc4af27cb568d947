"""Window operators over the daily panel.

Row windows (diff, running max, row index, first/last, tail-n) and the two
windowed score series:

* ``rolling_scores``   : FHS on [end - 180 d, end] for the last 45 ends.
* ``hopping_scores``   : FHS on 180-row windows every 30 rows.

Both use prefix sums in ONE ordered pass per series: every window is
(prefix at its last row) - (prefix ``length`` rows earlier), read with
``lag`` at a fixed offset. The panel is never exploded per window, and
the pass is partitioned by the series key only, which the panel already
has, so the whole computation adds no exchange.

Regularity (month-end closes after a 30-day cut-off) is expressed the
same way: running "last month-end so far" and "next month-end from
here" carries give the first close, the last full-month close and the
sum of squared full-month deltas of any window in O(1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.expr import clip, exact_avg, exp_decay, half_up
from ledgerscope.operators.scores import composite_raw, composite_score
from ledgerscope.params import DEFAULT_PARAMS, RiskParams


def _w(series):
    return Window.partitionBy(*series).orderBy("date")


# ---- simple row windows --------------------------------------------------

def daily_diff(panel: DataFrame, series=("customer_id",)) -> DataFrame:
    return panel.withColumn("diff", F.col("balance") - F.lag("balance").over(_w(series)))


def running_max(panel: DataFrame, series=("customer_id",)) -> DataFrame:
    w = _w(series).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return panel.withColumn("running_max", F.max("balance").over(w))


def row_index(panel: DataFrame, series=("customer_id",)) -> DataFrame:
    return panel.withColumn("idx", (F.row_number().over(_w(series)) - 1).cast("bigint"))


def first_last(panel: DataFrame, series=("customer_id",), value="balance") -> DataFrame:
    """Per series: first/last date and value (min_by / max_by, no sort)."""
    return panel.groupBy(*series).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by(value, "date").alias("first_value"),
        F.max_by(value, "date").alias("last_value"))


def tail_n(panel: DataFrame, n: int, series=("customer_id",)) -> DataFrame:
    """Last n rows of each series (row_number over date desc <= n)."""
    w = Window.partitionBy(*series).orderBy(F.col("date").desc())
    return (panel.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= n).drop("_rn"))


def calendar_month_bucket(panel: DataFrame, series=("customer_id",)) -> DataFrame:
    """Rows per calendar month per series, with month-start and month-end."""
    return (panel.groupBy(*series, F.trunc("date", "month").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_days"),
                 F.last_day(F.max("date")).alias("month_end"),
                 F.max_by("balance", "date").alias("close")))


# ---- prefix-sum window scores ----------------------------------------------

def _prefix_frame(panel: DataFrame, series, runmax: bool = False) -> DataFrame:
    """Adds idx, n and the running sums every window needs.

    Two ordered passes per series: ascending for the prefix sums, then
    descending for the "next month-end" carries (a running frame in the
    reverse order; an unbounded-following frame would be quadratic).
    """
    w = _w(series)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one window operator for everything that reads raw columns only
    is_me = F.last_day("date") == F.col("date")
    me = F.when(is_me, F.col("balance"))
    prev_me = F.last(me, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = F.col("balance") - F.lag("balance").over(w)
    base = panel.select(
        *series, "segment", "date", "balance",
        F.coalesce(d, F.lit(0.0)).alias("_d"),
        is_me.alias("_is_me"),
        (F.row_number().over(w) - 1).cast("double").alias("idx"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.last(me, ignorenulls=True).over(run).alias("_lme_bal"),
        F.sum(F.when(is_me, 1).otherwise(0)).over(run).alias("_me_cnt"),
        # squared full-month delta on month-end rows (previous month-end)
        F.coalesce(F.when(is_me, (F.col("balance") - prev_me) * (F.col("balance") - prev_me)),
                   F.lit(0.0)).alias("_fd2"),
        *([F.max("balance").over(run).alias("_runmax")] if runmax else []))
    base = base.select(
        "*",
        F.sum("balance").over(run).alias("_sy"),
        F.sum(F.col("idx") * F.col("balance")).over(run).alias("_siy"),
        F.sum("_d").over(run).alias("_sd"),
        F.sum(F.col("_d") * F.col("_d")).over(run).alias("_sd2"),
        F.sum(F.when(F.col("balance") < 0, 1).otherwise(0)).over(run).alias("_neg"),
        F.sum("_fd2").over(run).alias("_q"))
    back = Window.partitionBy(*series).orderBy(F.col("date").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return base.select(
        "*",
        F.last(F.when(F.col("_is_me"), F.col("balance")), ignorenulls=True).over(back).alias("_nme_bal"),
        F.last(F.when(F.col("_is_me"), F.col("_q")), ignorenulls=True).over(back).alias("_nme_q"))


def _window_scores(pref: DataFrame, series, length: int, is_end, p: RiskParams,
                   extra=()) -> DataFrame:
    """Scores of the window of ``length`` rows (or fewer at the series head)
    that ends on every row where ``is_end`` holds.

    Reads earlier rows with ``lead`` over the descending order, the order
    the previous pass left the rows in, so no further sort is needed.
    """
    wd = Window.partitionBy(*series).orderBy(F.col("date").desc())
    head = wd.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    L = length
    cut = p.regularity_cutoff_days

    def back(c, k):
        return F.lead(c, k).over(wd)

    def back0(c, k, default=0.0):
        return F.coalesce(back(c, k), F.lit(default))

    cols = [
        *series, "segment", "date", "idx", "n", "balance", *extra,
        F.least(F.lit(float(L)), F.col("idx") + 1).alias("m"),
        # sums over the window rows (prefix at end minus prefix L rows back)
        (F.col("_sy") - back0("_sy", L)).alias("sy"),
        (F.col("_siy") - back0("_siy", L)).alias("siy"),
        (F.col("_neg") - back0("_neg", L, 0)).alias("neg"),
        # diffs inside the window exclude its first row
        (F.col("_sd") - back0("_sd", L - 1)).alias("sd"),
        (F.col("_sd2") - back0("_sd2", L - 1)).alias("sd2"),
        # first row of the window (L-1 rows back, or the series head)
        F.coalesce(back("_nme_bal", L - 1), F.last("_nme_bal").over(head)).alias("nme_start"),
        F.coalesce(back("_nme_q", L - 1), F.last("_nme_q").over(head)).alias("q_c1"),
        back0("_me_cnt", L, 0).alias("me_cnt_before"),
        # cut-off: e' = end - 31 rows is the last kept row; e' - 1 before it
        back("balance", cut + 1).alias("bal_cut"),
        back("_lme_bal", cut + 2).alias("lme_cut"),
        back0("_me_cnt", cut + 2, 0).alias("me_cnt_cut"),
        back0("_q", cut + 2).alias("q_cut"),
        # no cut-off (windows of <= 60 rows): e' = end
        back("_lme_bal", 1).alias("lme_end"),
        back0("_me_cnt", 1, 0).alias("me_cnt_end"),
        back0("_q", 1).alias("q_end"),
    ]
    x = pref.select(*cols).where(is_end)
    return _score_columns(x, series, p, extra)


def _score_columns(x: DataFrame, series, p: RiskParams, extra=()) -> DataFrame:
    m = F.col("m")
    # trend: slope on local index 0..m-1, with a = idx - m + 1
    a = F.col("idx") - m + 1
    sx = m * (m - 1) / 2
    sxx = (m - 1) * m * (2 * m - 1) / 6
    sxy = F.col("siy") - a * F.col("sy")
    den = m * sxx - sx * sx
    slope = F.when(den > 0, F.try_divide(m * sxy - sx * F.col("sy"), den))
    trend = half_up(clip((slope + F.lit(p.trend_offset)) / F.lit(p.trend_divisor)), 2)
    # volatility: m-1 diffs
    k = m - 1
    var_d = F.greatest(F.try_divide(F.col("sd2") - F.try_divide(F.col("sd") * F.col("sd"), k),
                                    k - 1), F.lit(0.0))
    mean_b = F.col("sy") / m
    vol = (F.when(k == 0, F.lit(p.neutral_score))
           .when(k == 1, F.lit(None).cast("double"))
           .otherwise(half_up(exp_decay(F.sqrt(var_d) / (F.abs(mean_b) + F.lit(p.eps)),
                                         p.volatility_decay), 2)))
    debt = half_up(clip(F.lit(100.0) - F.lit(p.debt_factor) * (F.col("neg") / m)), 2)
    # regularity: closes = month-ends in [start, e') plus e'
    cut = m > p.regularity_min_rows
    me_cnt_last = F.when(cut, F.col("me_cnt_cut")).otherwise(F.col("me_cnt_end"))
    kk = me_cnt_last - F.col("me_cnt_before")              # number of deltas
    bal_last = F.when(cut, F.col("bal_cut")).otherwise(F.col("balance"))
    lme = F.when(cut, F.col("lme_cut")).otherwise(F.col("lme_end"))
    q_last = F.when(cut, F.col("q_cut")).otherwise(F.col("q_end"))
    # full-month deltas after the first close c1, plus the partial last one
    s1 = bal_last - F.col("nme_start")
    last_d = bal_last - lme
    s2 = (q_last - F.col("q_c1")) + last_d * last_d
    var_r = F.greatest(F.try_divide(s2 - F.try_divide(s1 * s1, kk), kk - 1), F.lit(0.0))
    cv = F.sqrt(var_r) / (F.abs(F.try_divide(s1, kk)) + F.lit(p.eps))
    reg = (F.when(kk <= 0, F.lit(p.neutral_score))
           .when(kk == 1, F.lit(None).cast("double"))
           .otherwise(half_up(exp_decay(cv, p.regularity_decay), 2)))
    out = x.select(*series, "segment", *extra, F.col("date").alias("end_date"),
                   trend.alias("balance_trend"), reg.alias("income_regularity"),
                   vol.alias("spending_volatility"), debt.alias("debt_ratio"))
    return out.select("*", composite_score(p=p).alias("fhs"),
                      composite_raw(p=p).alias("fhs_raw"))


def rolling_rows(p: RiskParams = DEFAULT_PARAMS) -> int:
    """Trailing rows per series that the rolling windows read."""
    return p.lookback_days + p.rolling_days


def rolling_scores(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS,
                   series=("customer_id",), trim: bool = True) -> DataFrame:
    """Per series and each of its last ``lookback_days`` dates: the scores
    of [end - rolling_days, end] (181 rows when the history allows).

    ``trim=False`` when the panel already holds only the trailing
    ``rolling_rows()`` days (``ledger_to_panel(keep_last=...)``), which
    saves a pass over the full history.
    """
    series = list(series)
    if trim:
        keep = rolling_rows(p)
        wd = Window.partitionBy(*series)
        panel = (panel.withColumn("_dmax", F.max("date").over(wd))
                 .where(F.col("date") > F.date_sub("_dmax", keep)).drop("_dmax"))
    pref = _prefix_frame(panel, series)
    rn_desc = F.col("n") - F.col("idx")          # 1 = last row
    return _window_scores(pref, series, p.rolling_days + 1, rn_desc <= p.lookback_days, p)


def rolling_daily_fhs(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS,
                      trim: bool = True) -> DataFrame:
    """segment, date, value: mean over customers of the rolling FHS."""
    return mean_by_day(rolling_scores(panel, p, trim=trim))


def mean_by_day(scores: DataFrame) -> DataFrame:
    """segment, date, value, n_customers of windowed scores."""
    return (scores.groupBy("segment", F.col("end_date").alias("date"))
            .agg(exact_avg("fhs", 2).alias("value"), F.count(F.lit(1)).alias("n_customers")))


def hopping_scores(panel: DataFrame, p: RiskParams = DEFAULT_PARAMS,
                   series=("customer_id",)) -> DataFrame:
    """Scores of row windows [s, s+180) for s = 0, 30, ... < n - 180.

    Series of at most ``hop_size`` rows have one window: the whole series
    (``win_start`` 0), which also covers the "fewer than 90 rows" fallback.
    """
    series = list(series)
    pref = _prefix_frame(panel, series)
    L = p.hop_size
    idx = F.col("idx")
    n = F.col("n")
    s = idx - (L - 1)
    full_end = (n > L) & (s >= 0) & (F.pmod(s, F.lit(float(p.hop_step))) == 0) & (s < n - L)
    short_end = (n <= L) & (idx == n - 1)
    pref = pref.withColumn("win_start", F.greatest(s, F.lit(0.0)).cast("bigint"))
    return _window_scores(pref, series, L, full_end | short_end, p, extra=("win_start",))
