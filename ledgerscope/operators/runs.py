"""Scores, shocks and features from runs of constant balance.

A balance changes only where money flows: about 40 runs stand for 2,500 days of a
customer. Everything the scores need has a closed form on a run of m days from
day a to day b with balance y: the sum of y, of day times y, of negative days,
the squared jump at its first day, and the month ends inside it. No day is
ever written out. All functions take runs as ``ledger_to_runs`` gives
them: (customer_id, segment, first_day, last_day, balance, d_start, d_end), hash-partitioned
by customer, the runs of a customer covering d_start to d_end without a gap.

Month-end closes are constant within a run, so only the first month end of a run can
differ from the close before it. A run that holds a month end is an ``owner``; the sum
of squared monthly changes adds one square per owner.

Windows of days (hopping and rolling) are measured per block of customers: a task reads
their runs as arrays, lays the days of a few hundred customers side by side
in memory and takes every window from prefix sums (``window_moments``), so no day or
window border is sorted, shuffled or spilled. Customers whose runs do not
tile the days once keep the marks: their runs are cut at the few rows around
each pane border, and windows are read a fixed number of marks apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.expr import clip, exact_avg, half_up, risk_tier
from ledgerscope.operators import scores as S
from ledgerscope.operators.segments import heatmap_from_scores
from ledgerscope.operators.windows import _score_columns, mean_by_day, rolling_rows
from ledgerscope.operators.windows import rolling_scores as dense_rolling_scores
from ledgerscope.params import DEFAULT_PARAMS, RiskParams
from ledgerscope.sources.ledger import expand_runs

KEY = ["customer_id", "segment"]
MONEY = "decimal(18,2)"


def panel_to_runs(panel: DataFrame) -> DataFrame:
    """Runs of any complete daily panel whose customers share their first and last day."""
    w = Window.partitionBy("customer_id").orderBy("date")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = panel.select(
        *KEY, "date", "balance", F.min("date").over(every).alias("d_start"), F.max("date").over(every).alias("d_end"),
        F.coalesce(F.lag("balance").over(w) != F.col("balance"), F.lit(True)).alias("starts"))
    rows = rows.where("starts")
    return rows.select(
        *KEY, F.col("date").alias("first_day"),
        F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("d_end")).alias("last_day"), "balance", "d_start", "d_end")


def _by_sound(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of customers with one account row and known balances, and those of all others."""
    w = _order()
    odd = F.col("balance").isNull() | F.coalesce(F.lag("first_day").over(w) == F.col("first_day"), F.lit(False))
    marked = runs.withColumn("_odd", odd).withColumn("_odd", F.max("_odd").over(Window.partitionBy("customer_id")))
    plain, others = (marked.where(c).drop("_odd") for c in (~F.col("_odd"), F.col("_odd")))
    return plain, others


def by_kind(runs: DataFrame, closed, dense, keep_last: int | None = None) -> DataFrame:
    """``closed`` of the runs of customers with one account row and known balances, ``dense`` of the daily panel
    (its trailing ``keep_last`` days if given) of all others.

    The closed forms count days; where an account row comes twice or an opening balance is
    null, rows of the panel are what counts. Both give the same columns.
    """
    plain, others = _by_sound(runs)
    return closed(plain).unionByName(dense(expand_runs(others, keep_last)))


def _order() -> Window:
    return Window.partitionBy("customer_id").orderBy("first_day")


def _months(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _is_month_end(day: Column) -> Column:
    return F.last_day(day) == day


def _last_month_end(day: Column) -> Column:
    """The last month end on or before ``day``."""
    return F.when(_is_month_end(day), day).otherwise(F.date_sub(F.trunc(day, "month"), 1))


def _first_month_end(day: Column) -> Column:
    """The first month end on or after ``day``."""
    return F.last_day(day)


def _kept_end(p: RiskParams) -> Column:
    """The last day that regularity reads: a long series leaves its last days out."""
    n = F.datediff("d_end", "d_start") + 1
    return F.when(n > p.regularity_min_rows, F.date_sub("d_end", p.regularity_cutoff_days + 1)).otherwise(F.col("d_end"))


def _with_days(runs: DataFrame, p: RiskParams) -> DataFrame:
    """Adds a, b (days from d_start), m, n, the jump d at a run's first day (null on the first run) and the month-end carries."""
    y, w = F.col("balance"), _order()
    end = _kept_end(p)
    stop = F.least(F.col("last_day"), F.col("_e"))
    rows = runs.select(
        *KEY, "first_day", "last_day", "balance", "d_start", "d_end", end.alias("_e"),
        F.datediff("first_day", "d_start").cast("double").alias("a"), F.datediff("last_day", "d_start").cast("double").alias("b"),
        (F.datediff("last_day", "first_day") + 1).cast("double").alias("m"),
        (F.datediff("d_end", "d_start") + 1).cast("double").alias("n"),
        (y - F.lag("balance").over(w)).alias("d"))
    rows = rows.withColumn("_owner", (F.col("first_day") <= F.col("_e")) & (_last_month_end(stop) >= F.col("first_day")))
    own = F.when(F.col("_owner"), y)
    return rows.withColumn("_before", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def customer_moments(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Per customer the columns of ``scores.series_moments`` and ``scores.delta_stats``."""
    rows = _with_days(runs, p)
    y, m, n, d = (F.col(c) for c in ("balance", "m", "n", "d"))
    holds_end = (F.col("first_day") <= F.col("_e")) & (F.col("_e") <= F.col("last_day"))
    jump = y - F.col("_before")
    tail = y - F.when(F.col("_owner"), y).otherwise(F.col("_before"))
    agg = rows.groupBy(*KEY).agg(
        F.first("n").alias("n"),
        # days are centred, so the slope needs no difference of large sums
        F.sum(y * m * ((F.col("a") + F.col("b")) / 2 - (n - 1) / 2)).alias("_sxy"),
        F.sum(y.cast(MONEY) * m.cast("int")).cast("double").alias("_sy"),
        F.sum(F.when(y < 0, m).otherwise(0.0)).alias("_neg"),
        F.max_by("balance", "first_day").alias("_y1"), F.min_by("balance", "first_day").alias("_y0"),
        F.coalesce(F.sum(d * d), F.lit(0.0)).alias("_sd2"),
        F.first(_months(F.col("_e")) - _months(F.col("d_start"))).alias("n_delta"),
        F.max(F.when(holds_end, y)).alias("_close1"),
        F.min_by(F.when(F.col("_owner"), y), F.when(F.col("_owner"), F.col("first_day"))).alias("_own0"),
        (F.coalesce(F.sum(F.when(F.col("_owner"), jump * jump)), F.lit(0.0))
         + F.coalesce(F.sum(F.when(holds_end & ~_is_month_end(F.col("_e")), tail * tail)), F.lit(0.0))).alias("_sm2"))
    n, k, kd = F.col("n"), F.col("n") - 1, F.col("n_delta")

    def deviation(squares: str, total: Column, count: Column) -> Column:
        return F.when(count > 1, F.sqrt(F.greatest((F.col(squares) - total * total / count) / (count - 1), F.lit(0.0))))

    change = F.col("_close1") - F.coalesce("_own0", "_close1")
    return agg.select(
        *KEY, n.cast("bigint").alias("n"),
        F.when(n > 1, F.try_divide(F.col("_sxy"), n * (n * n - 1) / 12)).alias("slope"),
        deviation("_sd2", F.col("_y1") - F.col("_y0"), k).alias("diff_std"), k.cast("bigint").alias("n_diff"),
        (F.col("_sy") / n).alias("bal_mean"), (F.col("_neg") / n).alias("pct_negative"),
        kd.cast("bigint").alias("n_delta"), deviation("_sm2", change, kd).alias("delta_std"),
        F.when(kd > 0, change / kd).alias("delta_mean"))


def customer_scores(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """As ``scores.customer_scores`` on the panel of these runs."""
    scored = customer_moments(runs, p).select(
        *KEY, S.trend_score(p=p).alias("balance_trend"), S.regularity_score(p=p).alias("income_regularity"),
        S.volatility_score(p=p).alias("spending_volatility"), S.debt_score(p=p).alias("debt_ratio"))
    return scored.select("*", S.composite_score(p=p).alias("fhs"), S.composite_raw(p=p).alias("fhs_raw"))


def segment_heatmap(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """segment, fhs, risk_label, four sub-score means; ascending fhs."""
    return heatmap_from_scores(customer_scores(runs, p), p=p).orderBy("fhs", "segment")


# ---- rows of the panel from runs ---------------------------------------------------------

def daily_diff(runs: DataFrame) -> DataFrame:
    """As ``windows.daily_diff`` on the panel: within a run nothing changes, so only its first day looks back."""
    d = F.col("balance") - F.lag("balance").over(_order())
    days = runs.withColumn("_d", d).select(
        *KEY, F.posexplode(F.sequence("first_day", "last_day")).alias("_k", "date"), "balance", "_d")
    return days.select(*KEY, "date", "balance", F.when(F.col("_k") == 0, F.col("_d")).otherwise(F.lit(0.0)).alias("diff"))


def running_max(runs: DataFrame) -> DataFrame:
    """As ``windows.running_max`` on the panel."""
    top = F.max("balance").over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.withColumn("running_max", top).select(
        *KEY, F.explode(F.sequence("first_day", "last_day")).alias("date"), "balance", "running_max")


def row_index(runs: DataFrame) -> DataFrame:
    """As ``windows.row_index`` on the panel: its rows are the days from d_start on."""
    days = runs.select(*KEY, F.explode(F.sequence("first_day", "last_day")).alias("date"), "balance", "d_start")
    return days.select(*KEY, "date", "balance", F.datediff("date", "d_start").cast("bigint").alias("idx"))


def tail_n(runs: DataFrame, n: int) -> DataFrame:
    """As ``windows.tail_n`` on the panel: its last rows are the last days."""
    return expand_runs(runs, keep_last=n)


# ---- shocks --------------------------------------------------------------------------

def split_moments(runs: DataFrame, cut: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Moments before and from the cut date (one row ``_cut``), as ``segments._split_moments``: a run
    that meets the cut counts in both parts."""
    w = _order()
    rows = runs.crossJoin(cut).select(
        *KEY, "first_day", "balance", F.lag("balance").over(w).alias("prev"), F.datediff("first_day", "_cut").cast("double").alias("x0"),
        F.datediff("last_day", "_cut").cast("double").alias("x1"))
    y, x0, x1 = F.col("balance"), F.col("x0"), F.col("x1")
    d = y - F.col("prev")
    pre_end, post_start = F.least(x1, F.lit(-1.0)), F.greatest(x0, F.lit(0.0))
    m_pre, m_post = F.greatest(pre_end - x0 + 1, F.lit(0.0)), F.greatest(x1 - post_start + 1, F.lit(0.0))
    sum_pre, sum_post = (x0 + pre_end) * m_pre / 2, (post_start + x1) * m_post / 2

    def squares(t: Column) -> Column:
        return t * (t + 1) * (2 * t + 1) / 6

    def total(v: Column) -> Column:
        return F.coalesce(F.sum(v), F.lit(0.0))

    at_cut = (x0 <= 0) & (x1 >= 0)
    return rows.groupBy(*KEY).agg(
        F.sum(m_pre + m_post).cast("bigint").alias("n"),
        F.sum((x0 + x1) * (x1 - x0 + 1) / 2).alias("sx"), F.sum(squares(x1) - squares(x0 - 1)).alias("sxx"),
        total(y * m_pre).alias("a_y"), total(y * m_post).alias("b_y"),
        total(y * sum_pre).alias("a_xy"), total(y * sum_post).alias("b_xy"),
        total(F.when(x0 < 0, d)).alias("a_d"), total(F.when(x0 < 0, d * d)).alias("a_d2"),
        total(F.when(x0 > 0, d)).alias("b_d"), total(F.when(x0 > 0, d * d)).alias("b_d2"),
        (F.sum(m_pre + m_post) - 1).cast("bigint").alias("n_diff"),
        F.max(F.when(at_cut, y)).alias("y_c"),
        F.max(F.when(at_cut, F.when(x0 < 0, y).otherwise(F.col("prev")))).alias("y_cm1"),
        F.sum(F.when(y < 0, m_pre).otherwise(0.0)).alias("neg_pre"), F.sum(F.when(y < 0, m_post).otherwise(0.0)).alias("neg_post"),
        F.sum(F.when(y > 0, m_post).otherwise(0.0)).alias("pos_post"))


def monthly_closes(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """customer_id, month, close, close_date of the days that regularity reads: a row per month, none per day."""
    rows = runs.withColumn("_e", _kept_end(p)).where(F.col("first_day") <= F.col("_e"))
    stop = F.least("last_day", "_e")
    rows = rows.select("customer_id", "balance", "_e", stop.alias("_stop"), F.explode(
        F.sequence(F.trunc("first_day", "month"), F.trunc(stop, "month"), F.expr("interval 1 month"))).alias("month"))
    day = F.least(F.last_day("month"), F.col("_e"))
    return rows.where(day <= F.col("_stop")).select(
        "customer_id", "month", F.col("balance").alias("close"), day.alias("close_date"))


def shocked_heatmaps(runs: DataFrame, shocks, cut: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Heatmap per (shock, segment); ``cut`` holds the date the shock begins, see ``segments.shock_cut``."""
    from ledgerscope.operators.segments import heatmaps_of_moments
    cut = F.broadcast(cut)
    return heatmaps_of_moments(split_moments(runs, cut, p), monthly_closes(runs, p), shocks, cut, p)


# ---- windows of days -------------------------------------------------------------------

BLOCK_DAYS = 1_000_000      # days of all customers laid out at once


def _prefix(v: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2 ... columns."""
    out = np.zeros((v.shape[0], v.shape[1] + 1))
    np.cumsum(v, axis=1, out=out[:, 1:])
    return out


def window_moments(y: np.ndarray, first_day: int, ends: np.ndarray, size: int, p: RiskParams = DEFAULT_PARAMS) -> dict:
    """What ``windows._score_columns`` reads of the windows of ``size`` days (or fewer at the head) that end at columns ``ends``.

    ``y`` holds customers by days; its first column is day ``first_day`` (days
    since 1970). Each value is one per customer and window, or one per window.
    """
    n, back = y.shape[1], p.regularity_cutoff_days + 1
    s = np.maximum(ends - size + 1, 0)
    m = ends - s + 1

    def within(v):
        sums = _prefix(v)
        return sums[:, ends + 1] - sums[:, s]

    d = np.zeros_like(y)
    d[:, 1:] = np.diff(y, axis=1)
    jumps = _prefix(d * d)
    out = {"m": m, "idx": ends, "win_start": s, "balance": y[:, ends], "sy": within(y), "siy": within(y * np.arange(n)),
           "neg": within(y < 0), "sd": y[:, ends] - y[:, s], "sd2": jumps[:, ends + 1] - jumps[:, s + 1]}
    # month ends fall on the same days for all customers
    months = (np.datetime64("1970-01-01") + (first_day + np.arange(n + 1))).astype("datetime64[M]")
    at = np.flatnonzero(months[1:] != months[:-1])
    before = np.searchsorted(at, s)
    last = np.where(m > p.regularity_min_rows, ends - back, ends)        # the last day that regularity reads
    count = np.searchsorted(at, last)                                    # month ends before it
    closes = y[:, at] if len(at) else y[:, :1]
    steps = np.zeros_like(closes)
    steps[:, 1:] = np.diff(closes, axis=1) ** 2
    squares = np.cumsum(steps, axis=1)
    lo, hi = np.minimum(before, closes.shape[1] - 1), np.maximum(count - 1, 0)
    return out | {"bal_last": y[:, last], "nme_start": closes[:, lo], "q_c1": squares[:, lo], "lme": closes[:, hi], "q_last": squares[:, hi],
                  "me_cnt_before": before, "me_cnt": count}


def _window_scores(runs: DataFrame, ends, size: int, p: RiskParams, extra=()) -> DataFrame:
    """Scores of the windows of ``size`` days that end on the days ``ends(n)`` of a series of n days.

    The runs must tile the days from d_start to d_end once. One row of arrays per
    customer goes to the tasks; days exist there only, ``BLOCK_DAYS`` at a time.
    """
    whole = F.array_sort(F.collect_list(F.struct("first_day", (F.datediff("last_day", "first_day") + 1).alias("m"), "balance")))
    each = runs.where(F.col("first_day").isNotNull()).groupBy(*KEY, "d_start", "d_end").agg(whole.alias("_r")).select(
        *KEY, F.unix_date("d_start").alias("d0"), (F.datediff("d_end", "d_start") + 1).alias("n"),
        F.transform("_r", lambda r: r["m"]).alias("days"), F.transform("_r", lambda r: r["balance"]).alias("balances"))
    ints = ("win_start", "me_cnt_before", "me_cnt")
    doubles = ("idx", "m", "balance", "sy", "siy", "neg", "sd", "sd2", "bal_last", "nme_start", "q_c1", "lme", "q_last")

    def run(batches):
        for b in batches:
            d0, n = b.column("d0").to_numpy(), b.column("n").to_numpy()
            for first, length in sorted(set(zip(d0.tolist(), n.tolist()))):
                same = b.filter(pa.array((d0 == first) & (n == length)))
                at = np.array(ends(length))
                rows = max(1, BLOCK_DAYS // length)
                for low in range(0, same.num_rows, rows):
                    part = same.slice(low, rows)
                    y = np.repeat(part.column("balances").flatten().to_numpy(), part.column("days").flatten().to_numpy()).reshape(part.num_rows, length)
                    got = window_moments(y, first, at, size, p)
                    got = {c: np.broadcast_to(got[c], (part.num_rows, len(at))).ravel() for c in (*ints, *doubles)}
                    key = pa.array(np.repeat(np.arange(part.num_rows), len(at)))
                    yield pa.RecordBatch.from_pydict({
                        **{c: part.column(c).take(key) for c in KEY},
                        "date": pa.array(np.tile(first + at, part.num_rows).astype("int32"), pa.int32()).cast(pa.date32()),
                        **{c: pa.array(got[c].astype(np.int64)) for c in ints}, **{c: pa.array(got[c].astype(float)) for c in doubles}})

    schema = "customer_id bigint, segment string, date date, " + ", ".join([f"{c} bigint" for c in ints] + [f"{c} double" for c in doubles])
    x = each.mapInArrow(run, schema)
    # the moments are those of the window's own last day, with or without a cut-off
    x = x.select("*", *[F.col(a).alias(b) for a, b in (("bal_last", "bal_cut"), ("lme", "lme_cut"), ("lme", "lme_end"), ("q_last", "q_cut"),
                                                        ("q_last", "q_end"), ("me_cnt", "me_cnt_cut"), ("me_cnt", "me_cnt_end"))])
    return _score_columns(x, ["customer_id"], p, extra)


def rolling_scores(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """As ``windows.rolling_scores`` on the panel of these runs, which must tile the days once."""
    since = F.greatest(F.date_sub("d_end", rolling_rows(p) - 1), F.col("d_start"))
    tail = runs.withColumn("d_start", since).where(F.col("last_day") >= F.col("d_start")).withColumn("first_day", F.greatest("first_day", "d_start"))
    lookback = p.lookback_days
    return _window_scores(tail, lambda n: range(max(0, n - lookback), n), p.rolling_days + 1, p)


def rolling_daily_fhs(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """As ``windows.rolling_daily_fhs`` on the panel of these runs."""
    return mean_by_day(by_kind(runs, lambda r: rolling_scores(r, p), lambda days: dense_rolling_scores(days, p, trim=False), rolling_rows(p)))


def shock_runs(runs: DataFrame, shocks, cut: DataFrame) -> DataFrame:
    """The runs under each shock, cut at the day the shock begins (one row ``_cut``); the segment carries the shock (``segment:shock``)."""
    parts = F.array(F.struct(F.col("first_day").alias("first_day"), F.least("last_day", F.date_sub("_cut", 1)).alias("last_day"), F.lit(False).alias("hit")),
                    F.struct(F.greatest("first_day", "_cut").alias("first_day"), F.col("last_day").alias("last_day"), F.lit(True).alias("hit")))
    s, y = F.col("shock"), F.col("balance")
    rows = runs.crossJoin(F.broadcast(cut)).select(*KEY, "balance", "d_start", "d_end", F.explode(parts).alias("part"))
    rows = rows.select(*KEY, "balance", "d_start", "d_end", "part.*").where("first_day <= last_day")
    rows = rows.withColumn("shock", F.explode(F.array(*[F.lit(int(x)) for x in shocks])))
    return rows.select(
        "customer_id", F.concat_ws(":", "segment", "shock").alias("segment"), "first_day", "last_day",
        F.when((s > 0) & F.col("hit"), y - y * (s.cast("double") / F.lit(100.0))).otherwise(y).alias("balance"), "d_start", "d_end")


# ---- hopping windows ----------------------------------------------------------------------

def window_marks(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """The prefix frame of the hopping windows at the rows around pane borders only.

    Rows 30 j - 3, - 2, - 1 and + 0 of each pane border (or the last row of a series too
    short for a window), with the columns that ``windows._score_columns``'s
    input is made of. All prefixes are inclusive.
    """
    w, y = _order(), F.col("balance")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("customer_id").orderBy(F.col("first_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.select(
        *KEY, "first_day", "balance", "d_start",
        F.datediff("first_day", "d_start").cast("double").alias("a"), F.datediff("last_day", "d_start").cast("double").alias("b"),
        (F.datediff("d_end", "d_start") + 1).cast("double").alias("n"),
        (y - F.lag("balance").over(w)).alias("d"), F.min_by("balance", "first_day").over(Window.partitionBy("customer_id")).alias("_y0"),
        (_last_month_end(F.col("last_day")) >= F.col("first_day")).alias("_owner"))
    own = F.when(F.col("_owner"), y)
    m = F.col("b") - F.col("a") + 1
    rows = rows.select(
        "*", F.last(own, ignorenulls=True).over(before).alias("_own_before"),
        F.coalesce(F.sum(y * m).over(before), F.lit(0.0)).alias("_sy0"),
        F.coalesce(F.sum(y * (F.col("a") + F.col("b")) * m / 2).over(before), F.lit(0.0)).alias("_siy0"),
        F.coalesce(F.sum(F.when(y < 0, m).otherwise(0.0)).over(before), F.lit(0.0)).alias("_neg0"),
        F.coalesce(F.sum(F.col("d") * F.col("d")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0)).alias("_sd2"))
    square = F.coalesce(F.when(F.col("_owner"), (y - F.col("_own_before")) * (y - F.col("_own_before"))), F.lit(0.0))
    rows = rows.withColumn("_sq", square).withColumn("_q0", F.coalesce(F.sum("_sq").over(before), F.lit(0.0)))
    rows = rows.select(
        "*", F.last(own, ignorenulls=True).over(after).alias("_own_after"),
        F.last(F.when(F.col("_owner"), F.col("_q0") + F.col("_sq")), ignorenulls=True).over(after).alias("_q_after"))
    # borders at 30 j; the marks of a run are those rows that lie in it
    step, size = p.hop_step, p.hop_size
    long_ = F.col("n") > size
    low = F.floor(F.col("a") / step).cast("int")
    high = (F.floor(F.col("b") / step) + 1).cast("int")
    marks = F.flatten(F.transform(F.sequence(low, high), lambda j: F.transform(
        F.array(*[F.lit(k) for k in (-3, -2, -1, 0)]), lambda k: (j * step + k).cast("double"))))
    marks = F.filter(marks, lambda r: (r >= F.col("a")) & (r <= F.col("b")))
    tail = F.filter(F.array(*[F.col("n") - k for k in (1.0, 2.0, p.regularity_cutoff_days + 2.0, p.regularity_cutoff_days + 3.0)]),
                    lambda r: (r >= F.col("a")) & (r <= F.col("b")))
    # a short series has one window, its whole length: its last rows and its first one
    short = F.array_sort(F.array_distinct(F.concat(tail, F.filter(F.array(F.lit(0.0)), lambda r: r >= F.col("a")))))
    rows = rows.withColumn("idx", F.explode(F.when(long_, marks).otherwise(short)))
    r = F.col("idx")
    day = F.date_add("d_start", r.cast("int"))
    in_run = r - F.col("a") + 1
    met = F.col("_owner") & (_first_month_end(F.col("first_day")) <= day)
    ahead = F.col("_owner") & (_first_month_end(day) <= F.date_add("d_start", F.col("b").cast("int")))
    return rows.select(
        *KEY, day.alias("date"), r.alias("idx"), "n", "balance", "_y0",
        (F.col("_sy0") + y * in_run).alias("_sy"), (F.col("_siy0") + y * (F.col("a") + r) * in_run / 2).alias("_siy"),
        (y - F.col("_y0")).alias("_sd"), "_sd2",
        (F.col("_neg0") + F.when(y < 0, in_run).otherwise(0.0)).alias("_neg"),
        (_months(day) - _months(F.col("d_start")) + _is_month_end(day).cast("int")).alias("_me_cnt"),
        F.when(met, y).otherwise(F.col("_own_before")).alias("_lme_bal"),
        (F.col("_q0") + F.when(met, F.col("_sq")).otherwise(0.0)).alias("_q"),
        F.when(ahead, y).otherwise(F.col("_own_after")).alias("_nme_bal"),
        F.when(ahead, F.col("_q0") + F.col("_sq")).otherwise(F.col("_q_after")).alias("_nme_q"))


def hopping_ends(n: int, p: RiskParams = DEFAULT_PARAMS) -> range:
    """Last rows of the windows of a series of n rows: one, its whole length, for a short series."""
    return range(n - 1, n) if n <= p.hop_size else range(p.hop_size - 1, n - 1, p.hop_step)


def plain_hopping_scores(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """As ``windows.hopping_scores`` on the panel of these runs, which must tile the days once."""
    return _window_scores(runs, lambda n: hopping_ends(n, p), p.hop_size, p, ("win_start",))


def hopping_scores(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """As ``windows.hopping_scores`` on the panel of these runs."""
    plain, others = _by_sound(runs)
    return plain_hopping_scores(plain, p).unionByName(marked_hopping_scores(others, p))


def marked_hopping_scores(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """``hopping_scores`` by marks, whatever rows the runs hold."""
    marks = window_marks(runs, p)
    step, size, cut = p.hop_step, p.hop_size, p.regularity_cutoff_days
    if size % step or cut % step or cut > size:
        raise ValueError("windows and the cut-off must be whole panes")
    pane, back_to_cut = 4 * (size // step), 4 * (cut // step)
    w = Window.partitionBy("customer_id").orderBy("idx")
    n, idx = F.col("n"), F.col("idx")
    s = idx - (size - 1)
    long_end = (n > size) & (s >= 0) & (F.pmod(s, F.lit(float(step))) == 0) & (s < n - size)
    short_end = (n <= size) & (idx == n - 1)

    def back(c: str, marks_back: int, rows_back: int) -> Column:
        """Value ``rows_back`` rows earlier: a fixed number of marks in long series, looked for among the few marks of a short one."""
        short = F.try_element_at(F.filter(F.col("_few"), lambda x: x["idx"] == idx - rows_back), F.lit(1))[c]
        return F.when(n > size, F.lag(c, marks_back).over(w)).otherwise(short)

    few = ("idx", "balance", "_lme_bal", "_me_cnt", "_q")
    marks = marks.withColumn("_few", F.when(n <= size, F.collect_list(F.struct(*few)).over(
        w.rowsBetween(-8, Window.currentRow))))
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = n <= size

    def before(c: str) -> Column:
        """Prefix just before the window: nothing precedes a series' first row."""
        return F.when(whole, F.lit(0.0)).otherwise(F.coalesce(F.lag(c, pane).over(w), F.lit(0.0)))

    def at_start(c: str) -> Column:
        return F.when(whole, F.first(c).over(first)).otherwise(F.lag(c, pane - 1).over(w))

    cols = [
        *KEY, "date", "idx", "n", "balance", F.greatest(s, F.lit(0.0)).cast("bigint").alias("win_start"),
        F.least(F.lit(float(size)), idx + 1).alias("m"),
        (F.col("_sy") - before("_sy")).alias("sy"), (F.col("_siy") - before("_siy")).alias("siy"),
        (F.col("_neg") - before("_neg")).alias("neg"),
        (F.col("_sd") - F.coalesce(at_start("_sd"), F.lit(0.0))).alias("sd"),
        (F.col("_sd2") - F.coalesce(at_start("_sd2"), F.lit(0.0))).alias("sd2"),
        at_start("_nme_bal").alias("nme_start"), at_start("_nme_q").alias("q_c1"),
        before("_me_cnt").alias("me_cnt_before"),
        back("balance", back_to_cut + 1, cut + 1).alias("bal_cut"), back("_lme_bal", back_to_cut + 2, cut + 2).alias("lme_cut"),
        F.coalesce(back("_me_cnt", back_to_cut + 2, cut + 2), F.lit(0)).alias("me_cnt_cut"),
        F.coalesce(back("_q", back_to_cut + 2, cut + 2), F.lit(0.0)).alias("q_cut"),
        back("_lme_bal", 1, 1).alias("lme_end"), F.coalesce(back("_me_cnt", 1, 1), F.lit(0)).alias("me_cnt_end"),
        F.coalesce(back("_q", 1, 1), F.lit(0.0)).alias("q_end")]
    x = marks.select(*cols).where(long_end | short_end)
    return _score_columns(x, ["customer_id"], p, ("win_start",))


# ---- features --------------------------------------------------------------------------------

def balance_features(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Whole-series features of each customer, unrounded; regularity without a cut-off."""
    w, y = _order(), F.col("balance")
    stop = F.col("last_day")
    rows = runs.select(
        *KEY, "first_day", "last_day", "balance", "d_start", "d_end",
        F.datediff("first_day", "d_start").cast("double").alias("a"), F.datediff("last_day", "d_start").cast("double").alias("b"),
        (F.datediff("last_day", "first_day") + 1).cast("double").alias("m"),
        (F.datediff("d_end", "d_start") + 1).cast("double").alias("n"),
        (y - F.lag("balance").over(w)).alias("d"),
        F.max("balance").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_top"),
        (F.sum(y.cast(MONEY) * (F.datediff("last_day", "first_day") + 1)).over(Window.partitionBy("customer_id")).cast("double")
         / (F.datediff("d_end", "d_start") + 1)).alias("_mean"),
        (_last_month_end(stop) >= F.col("first_day")).alias("_owner"))
    rows = rows.withColumn("_before", F.last(F.when(F.col("_owner"), y), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    d, m, n = F.col("d"), F.col("m"), F.col("n")
    spent = F.when(d < 0, -d).cast(MONEY)
    last = F.col("last_day") == F.col("d_end")
    jump = y - F.col("_before")
    part = y - F.when(F.col("_owner"), y).otherwise(F.col("_before"))
    agg = rows.groupBy(*KEY).agg(
        F.first("n").alias("n"), F.sum(y.cast(MONEY) * m.cast("int")).cast("double").alias("_sy"),
        F.sum((y - F.col("_mean")) * (y - F.col("_mean")) * m).alias("_syy"), F.sum(y * m * ((F.col("a") + F.col("b")) / 2 - (n - 1) / 2)).alias("_sxy"),
        F.coalesce(F.sum(F.abs(d).cast(MONEY)), F.lit(0)).cast("double").alias("_vel"), F.max(F.abs(d)).alias("_vel_max"),
        F.sum(F.when(y < 0, m).otherwise(0.0)).alias("_neg"), F.max(F.col("_top") - y).alias("max_drawdown"),
        F.sum(spent).cast("double").alias("_spent"), F.count(spent).alias("_spends"),
        F.max(F.when(last, y)).alias("_y1"),
        F.min_by(F.when(F.col("_owner"), y), F.when(F.col("_owner"), F.col("first_day"))).alias("_own0"),
        F.first(_months(F.col("d_end")) - _months(F.col("d_start"))).alias("_k"),
        (F.coalesce(F.sum(F.when(F.col("_owner"), jump * jump)), F.lit(0.0))
         + F.coalesce(F.sum(F.when(last & ~_is_month_end(F.col("d_end")), part * part)), F.lit(0.0))).alias("_s2"))
    n, k = F.col("n"), F.col("_k")
    mean = F.col("_sy") / n
    change = F.col("_y1") - F.coalesce("_own0", "_y1")
    var = F.greatest((F.col("_s2") - change * change / k) / (k - 1), F.lit(0.0))
    return agg.select(
        *KEY, n.cast("bigint").alias("n"), mean.alias("bal_mean"),
        F.sqrt(F.col("_syy") / n).alias("bal_std"),
        F.when(n > 1, F.col("_sxy") / (n * (n * n - 1) / 12)).alias("bal_trend"),
        F.when(n > 1, F.col("_vel") / (n - 1)).alias("vel_mean"),
        F.when(n > 1, F.coalesce("_vel_max", F.lit(0.0))).alias("vel_max"),
        (F.col("_neg") / n).alias("pct_negative_days"), "max_drawdown",
        F.when(F.col("_spends") > 0, F.col("_spent") / F.col("_spends")).alias("avg_expense"),
        F.when(k > 1, F.sqrt(var) / (F.abs(change / k) + F.lit(p.eps))).otherwise(F.lit(1.0)).alias("income_regularity"))


def customer_features(runs: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """As ``features.customer_features`` on the panel of these runs."""
    base = balance_features(runs, p)
    fhs = hopping_scores(runs, p).groupBy("customer_id").agg(
        exact_avg("fhs", 2).alias("fhs_mean"), F.count(F.lit(1)).alias("n_windows"), F.stddev_pop("fhs").alias("_fhs_std"))
    r = base.join(fhs, "customer_id")
    runway = clip(F.col("bal_mean") / (F.coalesce("avg_expense", F.lit(1.0)) + F.lit(p.eps)), 0.0, 365.0)
    fhs_std = F.when(F.col("n_windows") > 1, F.col("_fhs_std")).otherwise(F.lit(0.0))
    return r.select(
        *KEY, half_up("bal_mean", 2).alias("bal_mean"), half_up("bal_std", 2).alias("bal_std"), half_up("bal_trend", 4).alias("bal_trend"),
        half_up(F.col("bal_std") / (F.abs("bal_mean") + F.lit(p.eps)), 4).alias("bal_cv"),
        half_up(fhs_std, 4).alias("fhs_std"), half_up("income_regularity", 4).alias("income_regularity"),
        half_up("vel_mean", 2).alias("vel_mean"), half_up("vel_max", 2).alias("vel_max"),
        half_up("pct_negative_days", 4).alias("pct_negative_days"), half_up("max_drawdown", 2).alias("max_drawdown"),
        half_up(runway, 2).alias("runway_mean"), risk_tier("fhs_mean", p).alias("risk_tier"),
        half_up("fhs_mean", 2).alias("_fhs_mean"))
