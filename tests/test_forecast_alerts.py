"""Forecast, interval, backtest and alert rules on hand-made series."""

import datetime as dt

import numpy as np

from ledgerscope.operators import forecast as FC
from ledgerscope.operators import lookups as LK

FC_SCHEMA = "segment string, h int, yhat double, yhat_lower double, yhat_upper double"


def fc_df(spark, seg, yhat, lower, upper):
    rows = [(seg, i + 1, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(yhat, lower, upper))]
    return spark.createDataFrame(rows, FC_SCHEMA)


def test_flat_low_is_critical(spark):
    a = FC.detect_alerts(fc_df(spark, "S", [30] * 30, [20] * 30, [40] * 30)).collect()
    assert len(a) == 1 and a[0]["severity"] == "CRITICAL"


def test_flat_high_not_flagged(spark):
    assert FC.detect_alerts(fc_df(spark, "S", [80] * 30, [75] * 30, [85] * 30)).count() == 0


def test_steep_decline_uses_whole_horizon(spark):
    y = np.linspace(60, 10, 30)
    a = FC.detect_alerts(fc_df(spark, "S", y, np.linspace(50, 2, 30), np.linspace(70, 18, 30))).collect()
    assert len(a) == 1
    assert a[0]["min_lower"] == 2.0 and a[0]["fhs_day30"] == 10.0
    assert a[0]["min_lower"] <= a[0]["fhs_day30"] and a[0]["declining"]


def series_df(spark, values, seg="S", start=dt.date(2024, 1, 1)):
    rows = [(seg, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "segment string, date date, value double")


def test_interval_widens_with_horizon(spark):
    rng = np.random.default_rng(1)
    fc = FC.forecast_all(series_df(spark, rng.normal(70, 2, 45))).orderBy("h").collect()
    w1 = fc[0]["yhat_upper"] - fc[0]["yhat_lower"]
    w30 = fc[-1]["yhat_upper"] - fc[-1]["yhat_lower"]
    assert w30 > w1
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in fc)
    assert fc[0]["model_used"] == "holt"


def test_residual_floor(spark):
    """C8: diff std 0.49 -> 2.0; 0.5 stays 0.5."""
    a = series_df(spark, np.cumsum([0.0] + [0.49, -0.49] * 20), "A")
    b = series_df(spark, np.cumsum([0.0] + [0.5, -0.5] * 20), "B")
    s = {r["segment"]: r["resid_std"] for r in FC.residual_scale(a.unionByName(b)).collect()}
    assert s["A"] == 2.0 and abs(s["B"] - 0.5) < 1e-12


def test_holt_recovers_a_straight_line(spark):
    fc = FC.point_forecasts(series_df(spark, [10.0 + 0.5 * i for i in range(45)])).orderBy("h").collect()
    # last point 32.0, slope 0.5: h=1 -> 32.5, h=30 -> 47.0
    assert abs(fc[0]["yhat_holt"] - 32.5) < 1e-9 and abs(fc[-1]["yhat_holt"] - 47.0) < 1e-9


def test_mape_ignores_zero_actuals(spark):
    """C9."""
    rows = [("S", "m", 0.0, 1.0), ("S", "m", 2.0, 1.0), ("T", "m", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "segment string, model string, actual double, predicted double")
    m = {r["segment"]: r for r in FC.error_metrics(df).collect()}
    assert m["S"]["mape"] == 50.0 and m["T"]["mape"] == 0.0


def test_backtest_split_sizes(spark):
    sp = FC.chronological_split(series_df(spark, range(45))).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in sp} == {"train": 36, "test": 9}


def test_actions_match_severity(spark):
    assert len({(s, t) for s, t, _ in LK.ACTIONS}) == len({a for _, _, a in LK.ACTIONS}) == 15
    alerts = spark.createDataFrame([("BUILDING", "CRITICAL"), ("NOPE", "WARNING")], "segment string, severity string")
    out = {r["segment"]: r["recommended_action"] for r in LK.action_lookup(LK.alert_tier(alerts), "action_tier").collect()}
    assert out["BUILDING"] == dict(((s, t), a) for s, t, a in LK.ACTIONS)["BUILDING", "RED"] and out["NOPE"] == LK.DEFAULT_ACTION


def test_sentences(spark):
    df = spark.createDataFrame([("S", "First one. Ok. Second sentence here.")], "segment string, explanation string")
    got = [r["sentence"] for r in LK.sentences(df).orderBy("pos").collect()]
    assert got == ["First one.", "Second sentence here."]


def _holt_sse(y, a, b, l, t):
    sse = 0.0
    for v in y:
        f = l + t
        sse += (v - f) ** 2
        new = a * v + (1 - a) * f
        l, t = new, b * (new - l) + (1 - b) * t
    return sse, l, t


def test_holt_start_values_are_the_best_ones(spark):
    """The profiled start gives the least error for its weights, and never more than starting at the first two points."""
    rng = np.random.default_rng(5)
    for n in (3, 4, 12, 45):
        y = 60 + np.cumsum(rng.normal(0.2, 1.5, n))
        fit = FC.holt_fit(FC.as_arrays(series_df(spark, y))).first()
        a, b = fit.alpha, fit.beta
        cols = [np.array([_errors(y, a, b, *s) for s in ((0.0, 0.0),)][0])]
        base = cols[0]
        u, v = base - _errors(y, a, b, 1.0, 0.0), base - _errors(y, a, b, 0.0, 1.0)
        start, *_ = np.linalg.lstsq(np.stack([u, v], 1), base, rcond=None)
        sse, level, trend = _holt_sse(y, a, b, *start)
        assert abs(fit.sse - sse) < 1e-6 * max(1, sse) and abs(fit.level - level) < 1e-6 and abs(fit.trend - trend) < 1e-6
        old = min(_holt_sse(y[2:], i / 20, j / 20, y[1], y[1] - y[0])[0] for i in range(1, 21) for j in range(1, 21))
        assert fit.sse <= old + 1e-9


def _errors(y, a, b, l, t):
    out = []
    for v in y:
        f = l + t
        out.append(v - f)
        new = a * v + (1 - a) * f
        l, t = new, b * (new - l) + (1 - b) * t
    return np.array(out)


def _ses_sse(y, a):
    e = np.array([_errors(y, a, 0.0, s, 0.0) for s in (0.0, 1.0)])
    u = e[0] - e[1]
    l0 = (u @ e[0]) / (u @ u)
    return float(((e[0] - l0 * u) ** 2).sum())


def test_ses_alpha_is_placed_by_golden_section(spark):
    rng = np.random.default_rng(7)
    for n, noise in ((5, 1.0), (30, 1.0), (45, 4.0)):
        y = 50 + np.cumsum(rng.normal(0, 1, n)) + rng.normal(0, noise, n)
        fit = FC.ses_fit(FC.as_arrays(series_df(spark, y))).first()
        grid = min((_ses_sse(y, k / 20), k / 20) for k in range(1, 21))
        fine = min((_ses_sse(y, x), x) for x in np.linspace(max(grid[1] - 0.05, 1e-9), min(grid[1] + 0.05, 1.0), 2001))
        assert fit.sse <= grid[0] + 1e-9
        assert abs(fit.alpha - fine[1]) < 1e-4
        assert abs(fit.sse - _ses_sse(y, fit.alpha)) < 1e-6


def test_short_and_flat_series(spark):
    for y in ([5.0], [5.0, 6.0], [4.0] * 20, [1.0, 1.0, 1.0]):
        pf = FC.fallback_chain(FC.point_forecasts(series_df(spark, y))).collect()
        assert len(pf) == 30 and all(r.yhat_raw is not None for r in pf)
        if len(set(y)) == 1 and len(y) > 1:
            assert all(abs(r.yhat_raw - y[0]) < 1e-9 for r in pf)
