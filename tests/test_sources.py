"""Quarantine of foreign balance files, absent and broken result documents, the written feature table."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerscope.plans import q_misc as QM
from ledgerscope.plans import q_models as M
from ledgerscope.sources import ledger as L
from ledgerscope.sources import panel_store as PS
from ledgerscope.sources import results as R
from ledgerscope.sources.panel_store import save_panel_table

LINES = ["customer_id,segment,date,balance", "1,A,2024-01-01,10.0", "1,A,2024-01-01,9.5", "1,A,2024-01-02,x", "1,A,2024-01-05,7",
         "2,B,05/01/2024,1", "2,B,2024-01-05,", "2,B,2024-01-06,3.5,more,fields", "3,C", "", "oops", "2,B,2024-01-07,-2", "1,A,2024-01-01,10.0", "4,D,2024-01-01,NaN"]


def foreign(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "balances.csv").write_text("\n".join(LINES) + "\n")
    return str(tmp_path / "in")


def test_rows_of_a_foreign_file(spark, tmp_path):
    path = foreign(spark, tmp_path)
    day = lambda d: dt.date(2024, 1, d)
    got = sorted(tuple(r) for r in R.read_panel_csv(spark, path).collect())
    assert got == [(1, "A", day(1), 9.5), (1, "A", day(5), 7.0), (2, "B", day(7), -2.0)]
    counts = {r.status: r.n for r in R.quarantine_counts(R.scan_panel_csv(spark, path)).collect()}
    assert counts == {"accepted": 3, "malformed": 7, "duplicate": 2, "gap_day": 3}


def test_gaps_are_listed_and_filled(spark, tmp_path):
    panel = R.read_panel_csv(spark, foreign(spark, tmp_path))
    gaps = [tuple(r) for r in R.panel_gaps(panel).collect()]
    assert gaps == [(1, dt.date(2024, 1, 2), dt.date(2024, 1, 4), 3)]
    full = R.fill_gaps(panel)
    assert R.panel_gaps(full).count() == 0
    assert [r.balance for r in full.where("customer_id = 1").orderBy("date").collect()] == [9.5, 9.5, 9.5, 9.5, 7.0]


def test_absent_and_broken_documents(spark, tmp_path):
    base = str(tmp_path)
    names = list(R.RESULT_DOCS)
    assert [tuple(r)[1:] for r in R.read_docs(spark, base, names).collect()] == [(None, None)] * 4
    (tmp_path / "clustering").mkdir()
    (tmp_path / "clustering" / "part.json").write_text('{"k": 2, "inertia": 1.5, "silhouette": 0.5}\n{"k": 3, "iner\n\n{"k": "four"}\n')
    status = {r.doc: (r.n_accepted, r.n_rejected) for r in R.doc_status(spark, base).collect()}
    assert status == {"clustering": (1, 2), "classification_report": (None, None), "forecast_metrics": (None, None), "statistical_tests": (None, None)}
    rows = R.read_docs(spark, base, names).collect()
    assert sorted((r.doc, r.field, r.value) for r in rows if r.doc == "clustering") == [
        ("clustering", "inertia", "1.5"), ("clustering", "k", "2"), ("clustering", "silhouette", "0.5")]
    assert sum(r.field is None for r in rows) == 3


def test_days_are_written_without_being_shuffled(spark, monkeypatch):
    """A panel table from runs: one file per bucket, as many buckets as the days need, and the rows of the panel."""
    monkeypatch.setattr(PS, "BUCKET_ROWS", 5000)
    sf = "/root/testdata/sf0.001"
    panel = L.line_panel(spark, sf)
    t = PS.save_runs_as_panel(L.line_runs(spark, sf), panel.count())
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, panel.collect()))
    files = [f.split("_")[-1] for f in t.inputFiles()]
    assert len(files) == len(set(files)) > 4


def test_only_months_with_a_day_twice_are_dealt(spark, tmp_path):
    days = [(c, "A", dt.date(2024, m, d), float(d)) for c in range(3) for m in (1, 2) for d in range(1, 29)]
    panel = spark.createDataFrame([*days, (1, "A", dt.date(2024, 2, 7), 3.0), (1, "B", dt.date(2024, 2, 7), 9.0)], R.PANEL_SCHEMA)
    R.write_csv(panel, str(tmp_path / "in"))
    scanned = R.scan_panel_csv(spark, str(tmp_path / "in"))
    got = scanned.groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"accepted": 168, "duplicate": 2}
    assert scanned.where("status = 'accepted' AND customer_id = 1 AND date = '2024-02-07'").first().balance == 3.0
    assert "LeftAnti" in scanned._jdf.queryExecution().optimizedPlan().toString()


def test_calendar_of_months_is_the_calendar_of_days(spark):
    sf = "/root/testdata/sf0.001"
    got = QM.panel_calendar_join(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, L.line_panel(spark, sf).collect()))
    joins = [p for p in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftOuter" in p]
    assert any("month" in p for p in joins)


def test_each_saved_table_has_its_own_name(spark):
    df = spark.range(10).select(F.col("id").alias("customer_id"), F.current_date().alias("date"))
    a, b = save_panel_table(df, buckets=2), save_panel_table(df.where("customer_id < 5"), buckets=2)
    assert a.count() == 10 and b.count() == 5


def test_whole_pipeline_reads_one_feature_table(spark, monkeypatch):
    """All steps of the offline run are there; those on features scan the written table and no ledger."""
    monkeypatch.setattr(M.MD, "kmeans_models", lambda f, **_: real(f, ks=(2, 3), restarts=1))
    steps = M.run_risk_pipeline(spark, "/root/testdata/sf0.001")
    assert set(s for s, _, _ in M.PIPELINE_ROWS) < set(steps)
    for name, df in steps.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "o_totalprice" not in plan and "l_shipdate" not in plan, name
    rows = M.long_rows(steps, M.PIPELINE_ROWS).collect()
    assert {r.step for r in rows} == {s for s, _, _ in M.PIPELINE_ROWS}
    n = steps["features"].count()
    assert sum(r.value for r in rows if r.step in ("tier_distribution",)) == n == sum(r.value for r in rows if r.step == "cluster_crosstab")


real = M.MD.kmeans_models


def test_runs_are_written_as_the_lines_of_their_days(spark, tmp_path, monkeypatch):
    """Odd texts, unknown values, long runs: the same lines as from the panel; runs without days give none."""
    monkeypatch.setattr(R, "TEXT_DAYS", 7)
    monkeypatch.setattr(R, "TEXT_BYTES", 500)
    d = dt.date
    runs = spark.createDataFrame([
        (1, 'a "b", c', d(2023, 12, 20), d(2024, 3, 2), 1.5, d(2023, 12, 20), d(2024, 3, 2)), (2, None, d(2024, 1, 1), d(2024, 1, 1), -2.25e9, None, None),
        (3, "", d(2024, 1, 1), d(2024, 1, 3), None, None, None), (4, " é ", d(1969, 12, 30), d(1970, 1, 2), 0.0, None, None),
        (5, "a", None, None, 1.0, None, None)], "customer_id bigint, segment string, first_day date, last_day date, balance double, d_start date, d_end date")
    R.write_runs_csv(runs, str(tmp_path / "runs"))
    R.write_csv(L.expand_runs(runs), str(tmp_path / "days"))
    head = "customer_id,segment,date,balance"
    got, want = (sorted(r.value for r in spark.read.text(str(tmp_path / p)).collect() if r.value != head) for p in ("runs", "days"))
    assert got == want and len(got) == 74 + 1 + 3 + 4


def test_lines_are_parsed_once(spark, tmp_path):
    """The scan reads its parsed rows; no branch goes back to the text."""
    scanned = R.scan_panel_csv(spark, foreign(spark, tmp_path))
    for df in (scanned, R.quarantine_counts(scanned)):
        assert "Relation [customer_id" in df._jdf.queryExecution().optimizedPlan().toString()
        assert " csv" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert scanned.where("line = '2,B,05/01/2024,1' AND status = 'malformed'").count() == 1


def test_gaps_of_many_stretches(spark):
    """Gaps inside a stretch of 64 days, across stretches and before 1970; a day twice and an unknown day make none."""
    start = dt.date(1969, 6, 1)
    held = {1: [0, 1, 5, 5, 63, 64, 65, 300, 302, 430], 2: list(range(40, 500)), 3: [7]}
    rows = [(c, "A", start + dt.timedelta(d), 1.0) for c, days in held.items() for d in days] + [(1, "A", None, 1.0)]
    got = sorted(tuple(r) for r in R.panel_gaps(spark.createDataFrame(rows, R.PANEL_SCHEMA)).collect())
    want = [(1, start + dt.timedelta(a + 1), start + dt.timedelta(b - 1), b - a - 1) for a, b in zip(held[1], held[1][1:]) if b - a > 1]
    assert got == want
    plan = R.panel_gaps(spark.createDataFrame(rows, R.PANEL_SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")       # days are put together before anything is sorted


def test_runs_of_the_panel_table_are_dealt_once(spark, monkeypatch):
    """The customers of the runs lie in the table's buckets from the start; a bucket is one file of days in order."""
    monkeypatch.setattr(PS, "BUCKET_ROWS", 40_000)
    sf, seen = "/root/testdata/sf0.001", []
    monkeypatch.setattr(PS, "expand_runs", lambda runs: seen.append(runs) or L.expand_runs(runs))
    t = M.src_panel_table(spark, sf)
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, L.line_panel(spark, sf).collect()))
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    files = t.inputFiles()
    assert len(files) == len({f.split("_")[-1] for f in files}) > 4
    held = [tuple(r) for r in spark.read.parquet(files[0]).select("customer_id", "date").coalesce(1).collect()]
    assert held == sorted(held)


def test_steps_run_side_by_side(spark):
    """Each step waits for the other, so they end only if both have begun; results come in the order asked for, errors come through."""
    import threading

    import pytest
    from ledgerscope.session import side_by_side
    both = threading.Barrier(2)
    assert side_by_side(spark, lambda: (both.wait(60), spark.range(3).count())[1], lambda: (both.wait(60), "b")[1]) == [3, "b"]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, lambda: 1 / 0, lambda: 1)


def test_documents_take_predictions_once(spark, monkeypatch):
    """Both reports read written predictions, and the four documents are made side by side."""
    monkeypatch.setattr(M.MD, "kmeans_models", lambda f, **_: real(f, ks=(2, 3), restarts=1))
    plans, steps = [], []
    reports, beside = M.reports, M.side_by_side
    monkeypatch.setattr(M, "reports", lambda preds: plans.append(preds._jdf.queryExecution().optimizedPlan().toString()) or reports(preds))
    monkeypatch.setattr(M, "side_by_side", lambda s, *some: steps.append(len(some)) or beside(s, *some))
    rows = M.results_documents(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc for r in rows} == set(R.RESULT_DOCS) and all(r.field for r in rows)
    assert steps == [4] and plans[0].startswith("LogicalRDD")
