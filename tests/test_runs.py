"""Run-length scores, shocks, windows and features against the same operators on the dense panel."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import features as FT
from ledgerscope.operators import runs as R
from ledgerscope.operators import scores as S
from ledgerscope.operators import segments as G
from ledgerscope.operators import windows as W
from ledgerscope.sources import ledger as L


def ledger(spark, seed, customers, days, start=dt.date(2023, 1, 17), rate=0.03):
    """Runs and panel of a random ledger; also customers without any flow."""
    rng = random.Random(seed)
    flows = [(c, start + dt.timedelta(i), round(rng.uniform(-900, 900), 2)) for c in range(customers) for i in range(days) if rng.random() < rate * (c % 4)]
    flows += [(0, start, 0.0), (0, start + dt.timedelta(days - 1), 0.0)]
    f = spark.createDataFrame(flows, "customer_id bigint, date date, amount double").withColumn("amount", F.col("amount").cast("decimal(18,5)"))
    a = spark.createDataFrame([(c, f"S{c % 3}", float(rng.randrange(-500, 2000))) for c in range(customers)],
                              "customer_id bigint, segment string, opening double").withColumn("opening", F.col("opening").cast("decimal(18,5)"))
    runs = L.ledger_to_runs(f, a).cache()
    return runs, L.expand_runs(runs)


def same(a, b, key):
    x, y = ({tuple(r[k] for k in key): r.asDict() for r in d.collect()} for d in (a, b))
    assert x.keys() == y.keys() and x
    for k, row in x.items():
        for c, v in row.items():
            other = y[k][c]
            if isinstance(v, float) and other is not None:
                assert math.isclose(v, other, rel_tol=1e-9, abs_tol=0.0101 if c in ("fhs", "fhs_raw") else 1e-6), (k, c, v, other)
            else:
                assert v == other, (k, c, v, other)


LENGTHS = [1, 2, 20, 31, 32, 45, 60, 61, 75, 92, 130, 179, 180, 181, 210, 211, 365, 800]


@pytest.mark.parametrize("days", LENGTHS)
def test_scores_match_the_panel(spark, days):
    runs, panel = ledger(spark, days, 9, days, rate=0.1)
    same(R.customer_scores(runs), S.customer_scores(panel), ["customer_id"])


@pytest.mark.parametrize("days", [2, 20, 45, 60, 61, 92, 400])
@pytest.mark.parametrize("start", [dt.date(2023, 1, 31), dt.date(2024, 2, 1)])
def test_shock_grid_matches_the_panel(spark, days, start):
    runs, panel = ledger(spark, days + 1, 8, days, start, rate=0.1)
    cut = panel.agg(F.date_sub(F.max("date"), 30).alias("_cut"))
    shocks = (0, 10, 100, 130)
    same(R.shocked_heatmaps(runs, shocks, cut), G.shocked_heatmaps_fast(panel, shocks), ["shock", "segment"])


@pytest.mark.parametrize("days", LENGTHS)
def test_hopping_windows_match_the_panel(spark, days):
    runs, panel = ledger(spark, days + 2, 6, days, rate=0.1)
    same(R.hopping_scores(runs), W.hopping_scores(panel), ["customer_id", "win_start"])


@pytest.mark.parametrize("days", [2, 32, 61, 180, 181, 800])
def test_features_match_the_panel(spark, days):
    runs, panel = ledger(spark, days + 3, 8, days, rate=0.08)
    same(R.customer_features(runs), FT.customer_features(panel), ["customer_id"])


def test_runs_of_a_panel_and_back(spark):
    runs, panel = ledger(spark, 5, 7, 200)
    again = R.panel_to_runs(panel)
    assert sorted(map(tuple, L.expand_runs(again).collect())) == sorted(map(tuple, panel.collect()))
    assert again.count() <= runs.count()


def test_plans_write_out_no_day(spark):
    sf = "/root/testdata/sf0.001"
    import __spark_entry__ as E
    for name in ("customer_fhs", "segment_heatmap", "stress_shock_grid", "customer_features", "hopping_fhs", "score_debt_ratio"):
        plan = E.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().treeString()
        assert "explode(sequence(first_day" not in plan and "explode(sequence(date" not in plan, name


def odd_ledger(spark):
    """Runs where a customer's account row comes twice and another one's opening balance is unknown."""
    start = dt.date(2023, 1, 17)
    rng = random.Random(11)
    flows = [(c, start + dt.timedelta(i), round(rng.uniform(-900, 900), 2)) for c in range(6) for i in range(0, 230, 3 + 7 * c)]
    f = spark.createDataFrame(flows, "customer_id bigint, date date, amount double").withColumn("amount", F.col("amount").cast("decimal(18,5)"))
    a = spark.createDataFrame([(0, "A", 10.0), (1, "B", 20.0), (1, "B", 20.0), (2, "A", None), (3, None, -50.0), (4, "B", 0.0)],
                              "customer_id bigint, segment string, opening double").withColumn("opening", F.col("opening").cast("decimal(18,5)"))
    return L.ledger_to_runs(f, a).cache()


def rounded(df):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def days_moved(df):
    """Expressions that rows are dealt by, and whether a sort reads rows that were written out as days."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [part for part in plan.split("Window ")[1:] if "Generate" in part]


ROWS = [(R.daily_diff, W.daily_diff), (R.running_max, W.running_max), (R.row_index, W.row_index),
        (lambda r: R.tail_n(r, 30), lambda p: W.tail_n(p, 30))]


@pytest.mark.parametrize("closed, dense", ROWS)
def test_rows_of_runs_match_the_panel(spark, closed, dense):
    runs, panel = ledger(spark, 5, 9, 200, rate=0.1)
    assert rounded(closed(runs)) == rounded(dense(panel))
    assert not days_moved(closed(runs)) and days_moved(dense(panel))
    odd = odd_ledger(spark)
    names = closed(odd).columns
    assert rounded(R.by_kind(odd, closed, dense)) == rounded(dense(L.expand_runs(odd)).select(*names))


BALANCE = ["customer_id", "segment", "bal_mean", "bal_std", "bal_trend", "vel_mean", "vel_max", "pct_negative_days", "max_drawdown", "avg_expense"]
SERIES = [(lambda r: R.balance_features(r).select(*BALANCE), lambda p: FT.balance_features(p).select(*BALANCE)),
          (R.hopping_scores, W.hopping_scores), (R.customer_scores, S.customer_scores)]


@pytest.mark.parametrize("closed, dense", SERIES)
def test_repeated_accounts_and_unknown_balances_are_counted_by_rows(spark, closed, dense):
    odd = odd_ledger(spark)
    want = dense(L.expand_runs(odd))
    assert rounded(R.by_kind(odd, closed, dense).select(*want.columns)) == rounded(want)


@pytest.mark.parametrize("days, start", [(n, dt.date(2023, 1, 31) if n % 2 else dt.date(2024, 2, 1)) for n in (1, 32, 61, 181, 800)])
def test_rolling_windows_match_the_panel(spark, days, start):
    runs, panel = ledger(spark, days + 4, 7, days, start, rate=0.1)
    same(R.rolling_scores(runs), W.rolling_scores(panel), ["customer_id", "end_date"])


@pytest.mark.parametrize("days", [2, 61, 240])
def test_shocked_runs_match_the_shocked_panel(spark, days):
    runs, panel = ledger(spark, days + 5, 7, days, rate=0.1)
    cut = panel.agg(F.date_sub(F.max("date"), 30).alias("_cut"))
    grid = G.stress_shock_grid(panel, (0, 25, 130), cut=cut).withColumn("segment", F.concat_ws(":", "segment", "shock")).drop("shock")
    shocked = R.shock_runs(runs, (0, 25, 130), cut)
    assert rounded(L.expand_runs(shocked)) == rounded(grid)
    same(R.rolling_scores(shocked), W.rolling_scores(grid, series=("customer_id", "segment")), ["customer_id", "segment", "end_date"])


def test_blocks_do_not_change_the_windows(spark, monkeypatch):
    runs, _ = ledger(spark, 9, 9, 250, rate=0.1)
    whole = rounded(R.plain_hopping_scores(runs))
    monkeypatch.setattr(R, "BLOCK_DAYS", 600)
    assert rounded(R.plain_hopping_scores(runs)) == whole


def test_rolling_series_counts_odd_customers_by_rows(spark):
    odd = odd_ledger(spark)
    assert rounded(R.rolling_daily_fhs(odd)) == rounded(W.rolling_daily_fhs(L.expand_runs(odd)))


def test_odd_customers_keep_their_windows(spark):
    odd = odd_ledger(spark)
    assert rounded(R.hopping_scores(odd)) == rounded(R.marked_hopping_scores(odd))


def test_no_window_reads_days_or_marks_of_plain_customers(spark):
    runs, panel = ledger(spark, 5, 9, 200, rate=0.1)
    assert days_moved(W.rolling_scores(panel)) and days_moved(R.marked_hopping_scores(runs))
    assert not days_moved(R.plain_hopping_scores(runs)) and not days_moved(R.rolling_scores(runs))
