"""Reports and curves take the predictions once, however often they read them."""

import pytest

from ledgerscope.plans import q_misc as M


@pytest.mark.parametrize("query", ["classification_report", "roc_curve_ovr"])
def test_predictions_are_taken_once(spark, monkeypatch, query):
    rows = [(1, "High", 40.0, "High"), (2, "Low", 90.0, "Low"), (3, "Low", 70.0, "Medium"), (4, "Medium", 65.0, "Medium")]
    made = spark.createDataFrame(rows, "customer_id bigint, actual string, fhs double, predicted string").repartition(3, "customer_id")
    monkeypatch.setattr(M, "predictions", lambda *_: made)
    df = getattr(M, query)(spark, "none")
    assert "REPARTITION" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["class"]: r for r in df.collect()}
    assert set(got) >= {"High", "Low", "Medium"}
    if query == "classification_report":
        assert (got["accuracy"].f1, got["Low"].recall, got["Medium"].precision) == (0.75, 0.5, 0.5)
