"""Forecasters, prediction intervals and the backtest.

Input: a series frame ``(segment, date, value)``. Each series is short by
construction (``lookback_days`` points), so it is gathered once into a
date-sorted array per key -- a proven size bound -- and every model is a
column expression over that array:

* Holt (additive trend): every (alpha, beta) pair of a fixed grid is
  folded over the series with ``aggregate`` inside the series row, with the
  start level and trend that fit best for that pair (profiled least
  squares); the pair with the least squared one-step error wins (ties:
  smaller alpha, then beta). A second, finer grid around that optimum refines it.
* SES: the same in-row fold with no trend; alpha by golden section.
* linear: OLS over the last 30 points; naive; 7-point mean.

Series keys are independent, so the work spreads over keys (segments
here; customers would work the same way).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.expr import clip, half_up, risk_label
from ledgerscope.params import DEFAULT_PARAMS, RiskParams


def as_arrays(series: DataFrame, key: str = "segment") -> DataFrame:
    """key, dates (sorted), ys, n, last_date."""
    arr = F.array_sort(F.collect_list(F.struct("date", "value")))
    return (series.where(F.col("value").isNotNull()).groupBy(key).agg(arr.alias("_pts"))
            .select(key,
                    F.transform("_pts", lambda x: x["date"]).alias("dates"),
                    F.transform("_pts", lambda x: x["value"]).alias("ys"),
                    F.size("_pts").alias("n"),
                    F.element_at("_pts", -1)["date"].alias("last_date")))


# A state (level, trend) of exponential smoothing is linear in its start
# (l0, b0), and so is every one-step error: e_t = c_t - u_t l0 - v_t b0. The
# fold carries the three coefficients of the state and the sums of products of
# c, u and v; the best start for given smoothing weights then solves a 2x2 system.
# Values are taken relative to the first one, which keeps the sums small.

def _holt_fold(ys: Column, alpha: Column, beta: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    names = ("lc", "lu", "lv", "bc", "bu", "bv", "cc", "cu", "cv", "uu", "uv", "vv")
    init = F.struct(*[(one if c in ("lu", "bv") else zero).alias(c) for c in names])
    first = F.element_at(ys, 1)

    def step(s, y):
        fc, fu, fv = s["lc"] + s["bc"], s["lu"] + s["bu"], s["lv"] + s["bv"]
        e = y - first - fc
        keep, hold = one - alpha, one - beta
        lc, lu, lv = alpha * (y - first) + keep * fc, keep * fu, keep * fv
        return F.struct(
            lc.alias("lc"), lu.alias("lu"), lv.alias("lv"),
            (beta * (lc - s["lc"]) + hold * s["bc"]).alias("bc"),
            (beta * (lu - s["lu"]) + hold * s["bu"]).alias("bu"),
            (beta * (lv - s["lv"]) + hold * s["bv"]).alias("bv"),
            (s["cc"] + e * e).alias("cc"), (s["cu"] + e * fu).alias("cu"), (s["cv"] + e * fv).alias("cv"),
            (s["uu"] + fu * fu).alias("uu"), (s["uv"] + fu * fv).alias("uv"), (s["vv"] + fv * fv).alias("vv"))

    def finish(s):
        det = s["uu"] * s["vv"] - s["uv"] * s["uv"]
        sound = det > F.lit(1e-12) * s["uu"] * s["vv"]
        l0 = F.when(sound, (s["cu"] * s["vv"] - s["cv"] * s["uv"]) / det).otherwise(first - F.element_at(ys, 2))
        b0 = F.when(sound, (s["cv"] * s["uu"] - s["cu"] * s["uv"]) / det).otherwise(F.element_at(ys, 2) - first)
        sse = s["cc"] - F.lit(2.0) * (l0 * s["cu"] + b0 * s["cv"]) + l0 * l0 * s["uu"] + F.lit(2.0) * l0 * b0 * s["uv"] + b0 * b0 * s["vv"]
        return F.struct((first + s["lc"] + s["lu"] * l0 + s["lv"] * b0).alias("l"),
                        (s["bc"] + s["bu"] * l0 + s["bv"] * b0).alias("b"), F.greatest(sse, zero).alias("sse"))

    return F.aggregate(ys, init, step, finish)


def _ses_fold(ys: Column, alpha: Column) -> Column:
    """Level, squared error and summed error of the best start level for ``alpha``."""
    zero, one = F.lit(0.0), F.lit(1.0)
    init = F.struct(zero.alias("lc"), one.alias("lu"), zero.alias("cc"), zero.alias("cu"), zero.alias("uu"),
                    zero.alias("c"), zero.alias("u"))
    first = F.element_at(ys, 1)

    def step(s, y):
        e, keep = y - first - s["lc"], one - alpha
        return F.struct((alpha * (y - first) + keep * s["lc"]).alias("lc"), (keep * s["lu"]).alias("lu"),
                        (s["cc"] + e * e).alias("cc"), (s["cu"] + e * s["lu"]).alias("cu"), (s["uu"] + s["lu"] * s["lu"]).alias("uu"),
                        (s["c"] + e).alias("c"), (s["u"] + s["lu"]).alias("u"))

    def finish(s):
        l0 = s["cu"] / s["uu"]
        return F.struct((first + s["lc"] + s["lu"] * l0).alias("l"), F.greatest(s["cc"] - l0 * s["cu"], zero).alias("sse"),
                        (s["c"] - s["u"] * l0).alias("res"))

    return F.aggregate(ys, init, step, finish)


GOLDEN = (5 ** 0.5 - 1) / 2
GOLDEN_STEPS = 18       # 0.1 * GOLDEN ** 18 < 2e-5


REFINE_STEPS = 10       # fine grid: +-10 steps of step/20 around the coarse optimum


def _grid_pairs(alphas: Column, betas: Column) -> Column:
    """array<struct<alpha, beta>> in alpha-major order."""
    return F.flatten(F.transform(alphas, lambda a: F.transform(
        betas, lambda b: F.struct(a.alias("alpha"), b.alias("beta")))))


def _argmin_holt(ys: Column, pairs: Column) -> Column:
    """Fold every pair over the series and keep the least SSE; pairs are
    visited in (alpha, beta) order and only a strictly smaller SSE
    replaces the best, so ties go to the smaller alpha, then beta."""
    none = F.lit(None).cast("double")
    init = F.struct(none.alias("sse"), none.alias("alpha"), none.alias("beta"),
                    none.alias("l"), none.alias("b"))

    def step(best, pr):
        s = _holt_fold(ys, pr["alpha"], pr["beta"])
        take = best["sse"].isNull() | (s["sse"] < best["sse"])
        return F.when(take, F.struct(s["sse"].alias("sse"), pr["alpha"].alias("alpha"),
                                     pr["beta"].alias("beta"), s["l"].alias("l"), s["b"].alias("b"))
                      ).otherwise(best)

    return F.aggregate(pairs, init, step)


def _once(value: Column, name: str) -> Column:
    """``value`` as a generated column: a filter on it (or on a part of it) is not
    pushed below, where the optimiser would write out the whole fold again."""
    return F.explode(F.array(value)).alias(name)


def holt_fit(arrays: DataFrame, grid: DataFrame | None = None, key: str = "segment",
             step: float = DEFAULT_PARAMS.holt_grid_step) -> DataFrame:
    """key, alpha, beta, level, trend, sse for series of >= 3 points.

    Two grid stages, both folded inside the series row (no cross join, no
    shuffle, one row per series whatever the grid size): the coarse grid
    {k/K}, then a fine grid of step/20 around its optimum (which it
    contains, so the SSE can only go down).
    """
    k = int(round(1.0 / step))
    kf = float(k * 20)
    ks = [x / float(k) for x in range(1, k + 1)]
    axis = F.array(*[F.lit(x) for x in ks])
    ys = F.col("ys")
    coarse = _argmin_holt(ys, _grid_pairs(axis, axis))
    offs = F.sequence(F.lit(-REFINE_STEPS), F.lit(REFINE_STEPS))

    def around(c):
        return F.filter(F.transform(offs, lambda i: c + i / F.lit(kf)), lambda v: (v > 0) & (v <= 1))

    s1 = arrays.where(F.col("n") >= 3).select(key, "ys", _once(coarse, "_c"))
    fine = _argmin_holt(ys, _grid_pairs(around(F.col("_c.alpha")), around(F.col("_c.beta"))))
    best = s1.select(key, _once(fine, "m"))
    return best.select(key, F.col("m.alpha").alias("alpha"), F.col("m.beta").alias("beta"),
                       F.col("m.l").alias("level"), F.col("m.b").alias("trend"),
                       F.col("m.sse").alias("sse"))


def ses_fit(arrays: DataFrame, grid: DataFrame | None = None, key: str = "segment",
            step: float = DEFAULT_PARAMS.holt_grid_step) -> DataFrame:
    """key, alpha, level, bias (mean one-step residual), sse; >= 2 points.

    The start level is fitted for every alpha. The alpha grid {k/K} finds the
    basin (ties: smaller alpha); a golden-section search of a fixed number of
    steps between the neighbours of its best point places alpha to 1e-4. All of it
    is one expression on the series row. The grid point stays where the search is no better.
    """
    k = int(round(1.0 / step))
    alphas = F.array(*[F.lit(x / float(k)) for x in range(1, k + 1)])
    ys = F.col("ys")
    none = F.lit(None).cast("double")
    init = F.struct(none.alias("sse"), none.alias("alpha"))

    def pick(best, a):
        s = _ses_fold(ys, a)
        take = best["sse"].isNull() | (s["sse"] < best["sse"])
        return F.when(take, F.struct(s["sse"].alias("sse"), a.alias("alpha"))).otherwise(best)

    def narrow(s, _):
        left = s["fc"] <= s["fd"]
        lo, hi = F.when(left, s["lo"]).otherwise(s["c"]), F.when(left, s["d"]).otherwise(s["hi"])
        c = F.when(left, s["d"] - F.lit(GOLDEN) * (s["d"] - s["lo"])).otherwise(s["d"])
        d = F.when(left, s["c"]).otherwise(s["c"] + F.lit(GOLDEN) * (s["hi"] - s["c"]))
        new = _ses_fold(ys, F.when(left, c).otherwise(d))["sse"]
        return F.struct(lo.alias("lo"), hi.alias("hi"), c.alias("c"), d.alias("d"),
                        F.when(left, new).otherwise(s["fd"]).alias("fc"), F.when(left, s["fc"]).otherwise(new).alias("fd"))

    rows = arrays.where(F.col("n") >= 2).select(key, "n", "ys", F.aggregate(alphas, init, pick).alias("g"))
    rows = rows.select("*", F.greatest(F.col("g.alpha") - F.lit(1.0 / k), F.lit(0.0)).alias("lo"),
                       F.least(F.col("g.alpha") + F.lit(1.0 / k), F.lit(1.0)).alias("hi"))
    rows = rows.select("*", (F.col("hi") - F.lit(GOLDEN) * (F.col("hi") - F.col("lo"))).alias("c"),
                       (F.col("lo") + F.lit(GOLDEN) * (F.col("hi") - F.col("lo"))).alias("d"))
    start = F.struct("lo", "hi", "c", "d", _ses_fold(ys, F.col("c"))["sse"].alias("fc"), _ses_fold(ys, F.col("d"))["sse"].alias("fd"))
    rows = rows.select(key, "n", "ys", "g", F.aggregate(F.sequence(F.lit(1), F.lit(GOLDEN_STEPS)), start, narrow).alias("s"))
    rows = rows.select(key, "n", "ys", "g", ((F.col("s.lo") + F.col("s.hi")) / 2).alias("mid"))
    rows = rows.select(key, "n", "ys", _once(F.when(_ses_fold(ys, F.col("mid"))["sse"] < F.col("g.sse"), F.col("mid"))
                                             .otherwise(F.col("g.alpha")), "alpha"))
    return rows.select(key, "alpha", "n", _once(_ses_fold(ys, F.col("alpha")), "m")).select(
        key, "alpha", F.col("m.l").alias("level"), (F.col("m.res") / F.col("n")).alias("bias"), F.col("m.sse").alias("sse"))


def _tail_ols(ys: Column, n: Column, tail: int):
    """slope and intercept of OLS on the last ``tail`` points, x = 0..m-1."""
    m = F.least(n, F.lit(tail))
    t = F.slice(ys, n - m + 1, m)
    xs = F.sequence(F.lit(0), m - 1)
    pairs = F.zip_with(xs, t, lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y")))
    sx = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + e["x"])
    sy = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + e["y"])
    sxx = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + e["x"] * e["x"])
    sxy = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + e["x"] * e["y"])
    md = m.cast("double")
    den = md * sxx - sx * sx
    slope = F.when(den > 0, F.try_divide(md * sxy - sx * sy, den)).otherwise(F.lit(0.0))
    intercept = (sy - slope * sx) / md
    return slope, intercept, m


def horizon(h_max: int) -> Column:
    return F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(h_max).cast("bigint"))).alias("h")


def point_forecasts(series: DataFrame, p: RiskParams = DEFAULT_PARAMS, key: str = "segment",
                    h_max: int | None = None) -> DataFrame:
    """key, h, ds, yhat_holt, yhat_ses, yhat_linear, yhat_naive, yhat_sma.

    Raw (unclipped) point forecasts of every model for h = 1..h_max.
    """
    h_max = h_max or p.horizon
    arrs = as_arrays(series, key)
    holt = holt_fit(arrs, key=key, step=p.holt_grid_step)
    ses = ses_fit(arrs, key=key, step=p.holt_grid_step)
    slope30, icpt30, m30 = _tail_ols(F.col("ys"), F.col("n"), p.linear_tail)
    sma_m = F.least(F.col("n"), F.lit(p.sma_window))
    sma = F.aggregate(F.slice("ys", F.col("n") - sma_m + 1, sma_m), F.lit(0.0),
                      lambda a, y: a + y) / sma_m
    base = (arrs.join(holt.select(key, "level", "trend", F.col("alpha").alias("h_alpha"),
                                  F.col("beta").alias("h_beta")), key, "left")
            .join(ses.select(key, F.col("level").alias("s_level"), "bias",
                             F.col("alpha").alias("s_alpha")), key, "left")
            .select(key, "n", "last_date", "ys", "level", "trend", "h_alpha", "h_beta",
                    "s_level", "bias", "s_alpha",
                    slope30.alias("slope30"), icpt30.alias("icpt30"), m30.alias("m30"),
                    sma.alias("sma"), F.element_at("ys", -1).alias("last_value")))
    h = F.col("h").cast("double")
    return base.select("*", horizon(h_max)).select(
        key, "h", F.date_add("last_date", F.col("h").cast("int")).alias("ds"), "n", "ys",
        "h_alpha", "h_beta", "s_alpha",
        (F.col("level") + h * F.col("trend")).alias("yhat_holt"),
        (F.col("s_level") + F.col("bias") + h * F.col("slope30")).alias("yhat_ses"),
        (F.col("s_level")).alias("yhat_ses_flat"),
        (F.col("icpt30") + F.col("slope30") * (F.col("m30") - 1 + h)).alias("yhat_linear"),
        F.col("last_value").alias("yhat_naive"),
        F.col("sma").alias("yhat_sma"))


def fallback_chain(pf: DataFrame) -> DataFrame:
    """Adds yhat_raw and model_used: Holt when fitted (>= 3 points and a
    finite fit), else SES with slope correction, else linear."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return pf.select(
        "*",
        F.when(finite("yhat_holt"), F.col("yhat_holt"))
        .when(finite("yhat_ses"), F.col("yhat_ses"))
        .otherwise(F.col("yhat_linear")).alias("yhat_raw"),
        F.when(finite("yhat_holt"), "holt").when(finite("yhat_ses"), "ses")
        .otherwise("linear").alias("model_used"))


def residual_scale(series: DataFrame, p: RiskParams = DEFAULT_PARAMS, key: str = "segment") -> DataFrame:
    """key, resid_std: population std of the first differences; below the
    floor (or missing) it becomes the default 2.0."""
    w = Window.partitionBy(key).orderBy("date")
    d = series.select(key, (F.col("value") - F.lag("value").over(w)).alias("d"))
    s = d.groupBy(key).agg(F.stddev_pop("d").alias("s"))
    return s.select(key, F.when(F.col("s").isNull() | F.isnan("s") | (F.col("s") < p.resid_floor),
                                F.lit(p.resid_default)).otherwise(F.col("s")).alias("resid_std"))


def with_interval(fc: DataFrame, scale: DataFrame, p: RiskParams = DEFAULT_PARAMS,
                  key: str = "segment", point: str = "yhat_raw") -> DataFrame:
    """yhat clipped to 0..100; margin = z * s * sqrt(h); bounds clipped;
    everything rounded to 2 decimals."""
    j = fc.join(scale, key)
    yhat = clip(F.col(point))
    margin = F.lit(p.z) * F.col("resid_std") * F.sqrt(F.col("h").cast("double"))
    return j.select(
        "*",
        half_up(yhat, 2).alias("yhat"),
        half_up(clip(yhat - margin), 2).alias("yhat_lower"),
        half_up(clip(yhat + margin), 2).alias("yhat_upper"))


def forecast_all(series: DataFrame, p: RiskParams = DEFAULT_PARAMS, key: str = "segment") -> DataFrame:
    """key, h, ds, yhat, yhat_lower, yhat_upper, model_used for every series."""
    fc = fallback_chain(point_forecasts(series, p, key))
    out = with_interval(fc, residual_scale(series, p, key), p, key)
    return out.select(key, "h", "ds", "yhat", "yhat_lower", "yhat_upper", "model_used")


# ---- backtest ----------------------------------------------------------------

def chronological_split(series: DataFrame, p: RiskParams = DEFAULT_PARAMS,
                        key: str = "segment") -> DataFrame:
    """Adds t (1-based), n, split ('train'/'test'); series with fewer than
    10 points or fewer than 3 test points are dropped."""
    w = Window.partitionBy(key).orderBy("date")
    s = series.select("*", F.row_number().over(w).alias("t"),
                      F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    cut = F.floor(F.col("n") * F.lit(p.train_share))
    return (s.withColumn("n_train", cut.cast("int"))
            .where((F.col("n") >= p.backtest_min_points)
                   & (F.col("n") - F.col("n_train") >= p.backtest_min_test))
            .withColumn("split", F.when(F.col("t") <= F.col("n_train"), "train").otherwise("test")))


def backtest_predictions(series: DataFrame, p: RiskParams = DEFAULT_PARAMS,
                         key: str = "segment") -> DataFrame:
    """key, model, date, actual, predicted on the test part of each series.

    Models: naive, sma, holt_winters (Holt, else flat SES, else naive).
    """
    sp = chronological_split(series, p, key)
    train = sp.where(F.col("split") == "train").select(key, "date", "value")
    test = sp.where(F.col("split") == "test").select(
        key, "date", F.col("value").alias("actual"), (F.col("t") - F.col("n_train")).alias("h"))
    n_test_max = p.lookback_days  # horizon long enough for any test part
    pf = point_forecasts(train, p, key, h_max=n_test_max)
    hw = (F.when(F.col("yhat_holt").isNotNull() & ~F.isnan("yhat_holt"), F.col("yhat_holt"))
          .when(F.col("yhat_ses_flat").isNotNull(), F.col("yhat_ses_flat"))
          .otherwise(F.col("yhat_naive")))
    preds = pf.select(key, "h", F.col("yhat_naive").alias("naive"), F.col("yhat_sma").alias("sma"),
                      hw.alias("holt_winters"))
    j = test.join(preds, [key, "h"])
    return j.select(key, "date", "actual", F.explode(F.array(
        F.struct(F.lit("naive").alias("model"), F.col("naive").alias("predicted")),
        F.struct(F.lit("sma").alias("model"), F.col("sma").alias("predicted")),
        F.struct(F.lit("holt_winters").alias("model"), F.col("holt_winters").alias("predicted")),
    )).alias("m")).select(key, "m.model", "date", "actual", "m.predicted")


def error_metrics(pred: DataFrame, keys=("segment", "model")) -> DataFrame:
    """RMSE, MAE (4 dp) and MAPE in % over non-zero actuals (2 dp, 0 if none)."""
    r = F.col("actual") - F.col("predicted")
    nz = F.col("actual") != 0
    mape = F.avg(F.when(nz, F.abs(r / F.col("actual"))))
    return pred.groupBy(*keys).agg(
        half_up(F.sqrt(F.avg(r * r)), 4).alias("rmse"),
        half_up(F.avg(F.abs(r)), 4).alias("mae"),
        half_up(F.coalesce(mape * F.lit(100.0), F.lit(0.0)), 2).alias("mape"),
        F.count(F.lit(1)).alias("n_test"))


def backtest_summary(metrics: DataFrame, key: str = "segment") -> DataFrame:
    """Holt wins over naive (strictly lower RMSE) and the mean RMSE gain in %."""
    wide = metrics.groupBy(key).pivot("model", ["naive", "sma", "holt_winters"]).agg(F.first("rmse"))
    gain = F.when(F.col("naive") > 0, (F.col("naive") - F.col("holt_winters")) / F.col("naive") * 100.0)
    return wide.agg(
        F.count_if(F.col("holt_winters") < F.col("naive")).cast("bigint").alias("hw_wins"),
        F.count(F.lit(1)).alias("n_segments"),
        half_up(F.coalesce(F.avg(gain), F.lit(0.0)), 1).alias("avg_rmse_improvement_pct"))


def best_model(metrics: DataFrame, key: str = "segment") -> DataFrame:
    """Lowest RMSE per series; ties go to Holt, then SMA, then naive."""
    prio = (F.when(F.col("model") == "holt_winters", 0).when(F.col("model") == "sma", 1)
            .otherwise(2))
    return metrics.groupBy(key).agg(
        F.min_by("model", F.struct("rmse", prio)).alias("best_model"),
        F.min("rmse").alias("best_rmse"))


# ---- alerts and KPIs -------------------------------------------------------

def forecast_kpis(fc: DataFrame, key: str = "segment") -> DataFrame:
    g = fc.groupBy(key).agg(
        F.min_by("yhat", "h").alias("day1"), F.max_by("yhat", "h").alias("day30"),
        F.min("yhat_lower").alias("min_lower"), F.max("yhat_upper").alias("max_upper"))
    delta = F.col("day30") - F.col("day1")
    return g.select(key, "day1", "day30", half_up(delta, 2).alias("delta"),
                    F.when(delta >= 0, "up").otherwise("down").alias("arrow"),
                    "min_lower", "max_upper")


def detect_alerts(fc: DataFrame, p: RiskParams = DEFAULT_PARAMS, key: str = "segment") -> DataFrame:
    """Worst lower bound over the whole horizon, first vs last point.

    Alert when min lower < 35 or the path declines by more than 1 point;
    CRITICAL when min lower < 35, else WARNING. History is not used.
    """
    g = fc.groupBy(key).agg(F.min("yhat_lower").alias("_min"),
                            F.min_by("yhat", "h").alias("_d1"),
                            F.max_by("yhat", "h").alias("_d30"))
    declining = F.col("_d30") < F.col("_d1") - F.lit(p.decline_margin)
    crit = F.col("_min") < F.lit(p.alert_floor)
    return (g.where(crit | declining)
            .select(key, half_up("_min", 1).alias("min_lower"), half_up("_d1", 1).alias("fhs_day1"),
                    half_up("_d30", 1).alias("fhs_day30"), declining.alias("declining"),
                    F.when(crit, "CRITICAL").otherwise("WARNING").alias("severity")))


def forecast_summary(fc: DataFrame, p: RiskParams = DEFAULT_PARAMS, key: str = "segment") -> DataFrame:
    """Percent change, direction, day-30 risk, half-window means and a trend
    note (second half differs from the first by more than 0.5)."""
    g = fc.groupBy(key).agg(
        F.min_by("yhat", "h").alias("day1"), F.max_by("yhat", "h").alias("day30"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("h", "yhat"))).alias("path"))
    # at most one row per horizon step and key, so the path is short
    half = F.floor(F.col("n") / 2).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x["yhat"])
    first = F.try_divide(total(F.slice("path", F.lit(1), half)), half)
    second = total(F.slice("path", half + 1, F.col("n").cast("int"))) / (F.col("n") - half)
    delta = F.col("day30") - F.col("day1")
    return g.select(
        key, "day1", "day30",
        half_up(F.try_divide(delta, F.col("day1")) * 100.0, 1).alias("pct_change"),
        F.when(delta >= 0, "increase").otherwise("decline").alias("direction"),
        risk_label("day30", p).alias("day30_label"),
        half_up(first, 2).alias("first_half_mean"), half_up(second, 2).alias("second_half_mean"),
        F.when(second < first - 0.5, "downtrend").when(second > first + 0.5, "recovery")
        .otherwise("none").alias("trend_note"))
