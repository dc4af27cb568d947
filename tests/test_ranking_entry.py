"""Distributed ranks, leakage guard, panel contract and the driver entry."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerscope.operators import features as FT
from ledgerscope.operators import metrics as MT
from ledgerscope.operators import ranking as RK
from ledgerscope.sources import ledger as L

SMOKE = "/root/testdata/sf0.001"


def test_average_rank_matches_pandas(spark):
    rng = np.random.default_rng(5)
    vals = rng.integers(0, 40, 500).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"i": range(500), "v": vals}))
    got = RK.average_rank(df, "v", "r").toPandas().sort_values("i")["r"].to_numpy()
    want = pd.Series(vals).rank(method="average").to_numpy()
    assert np.allclose(got, want)


def test_running_sums_by_group(spark):
    df = spark.createDataFrame([(g, float(k), 1.0) for g in ("a", "b") for k in range(300)],
                               "g string, k double, one double")
    r = RK.running_sums(df, "k", ["one"], by=("g",)).toPandas()
    assert (r["run_one"] == r["k"] + 1).all()


def test_auc_perfect_and_random(spark):
    rows = [("c", 1, 0.9), ("c", 1, 0.8), ("c", 0, 0.1), ("c", 0, 0.2),
            ("d", 1, 0.5), ("d", 0, 0.5)]
    df = spark.createDataFrame(rows, "class string, is_pos int, score double")
    auc = {r["class"]: r["auc"] for r in MT.roc_auc(df).collect()}
    assert auc == {"c": 1.0, "d": 0.5}


def test_feature_projection_excludes_leakage(spark):
    df = spark.createDataFrame([(1, *[0.0] * 11, 50.0)],
                               "customer_id long, " + ", ".join(f"{c} double" for c in FT.FEATURES) + ", _fhs_mean double")
    cols = FT.feature_projection(df).columns
    assert "_fhs_mean" not in cols and "fhs_mean" not in cols and len(cols) == 12


def test_panel_contract(spark):
    p = L.line_panel(spark, SMOKE)
    prof = p.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("c"),
                 F.countDistinct("date").alias("d")).first()
    assert prof["n"] == prof["c"] * prof["d"] and prof["d"] > 2000
    dup = p.groupBy("customer_id", "date").count().where("count > 1").count()
    assert dup == 0
    assert [f.name for f in p.schema.fields] == ["customer_id", "segment", "date", "balance"]


def test_panel_keep_last_matches_full(spark):
    full = L.line_panel(spark, SMOKE)
    tail = L.line_panel(spark, SMOKE, keep_last=20)
    last = full.agg(F.max("date")).first()[0]
    a = full.where(F.datediff(F.lit(last), "date") < 20).exceptAll(tail).count()
    assert a == 0 and tail.count() == full.select("customer_id").distinct().count() * 20


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["segment", "fhs", "risk_label", "balance_trend", "income_regularity",
                          "spending_volatility", "debt_ratio"]
    assert set(E.oracle_sql()) <= set(E.queries())


def _running(rows, ascending=True):
    out, total = {}, {}
    key = lambda r: (r[1] is not None, r[1] if r[1] is not None else 0)  # noqa: E731  NULL keys first
    for g, k, x in sorted(rows, key=key, reverse=not ascending):
        total[g] = total.get(g, 0.0) + (x or 0.0)
        out[g, k] = total[g]
    return out


def test_running_sums_negative_values_null_groups_and_keys(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", None if i == 7 else i * 37 % 1009, None if i % 11 == 0 else -1.0 - i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, x double")
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        for ascending in (True, False):
            got = RK.running_sums(df, "k", ["x"], by=("g",), ascending=ascending).collect()
            assert {(r["g"], r["k"]): r["run_x"] for r in got} == _running(rows, ascending)
    spark.conf.set("spark.sql.exchange.reuse", "true")


def test_row_numbers_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    r = RK.global_row_number(spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("k")), "k")
    s = r.agg(F.countDistinct("rn").alias("d"), F.max("rn").alias("m"), F.sum((F.col("rn") != F.col("k") + 1).cast("int")).alias("bad")).first()
    spark.conf.set("spark.sql.exchange.reuse", "true")
    assert (s["d"], s["m"], s["bad"]) == (400_000, 400_000, 0)


def test_row_numbers_of_strings_and_dates(spark):
    words = [f"{c}{i}" for c in "zéaB" for i in range(40)]
    got = RK.global_row_number(spark.createDataFrame([(w,) for w in words], "k string"), "k").collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["rn"])] == sorted(words, key=lambda w: w.encode())
    days = RK.global_row_number(spark.sql("SELECT explode(sequence(DATE '1960-01-01', DATE '1975-01-01')) AS k"), "k").collect()
    assert [r["k"] for r in sorted(days, key=lambda r: r["rn"])] == sorted(r["k"] for r in days)


def test_null_values_and_tiers_are_kept(spark):
    from ledgerscope.operators import metrics as MT
    from ledgerscope.plans.q_misc import stratified_split
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "High") for i in range(20)], "customer_id long, risk_tier string")
    split = stratified_split(df).groupBy("risk_tier", "split").count().collect()
    assert {(r["risk_tier"], r["split"]): r["count"] for r in split} == {
        ("High", "train"): 13, ("High", "test"): 3, (None, "train"): 3, (None, "test"): 1}
    ranks = RK.average_rank(spark.createDataFrame([(1.0,), (None,), (1.0,)], "v double"), "v", "r").collect()
    assert sorted((r["v"] is None, r["r"]) for r in ranks) == [(False, 1.5), (False, 1.5), (True, None)]
    enc = MT.label_encode(df, "risk_tier").groupBy("risk_tier", "label_index").count().collect()
    assert {(r["risk_tier"], r["label_index"]) for r in enc} == {("High", 0), (None, None)}


def test_p_values(spark):
    import numpy as np
    from ledgerscope.operators import stats as ST
    p = spark.createDataFrame([(0.0,), (0.0012345,), (4.5678e-20,), (0.25,)], "p double")
    assert [r[0] for r in p.select(ST.p_round("p")).collect()] == [0.0, 0.00123, 4.57e-20, 0.25]
    rng = np.random.default_rng(0)
    far = spark.createDataFrame([(g, float(v)) for g, m in (("a", 10), ("b", 60), ("c", 90)) for v in rng.normal(m, 3, 200)], "g string, x double")
    r = ST.with_anova_pvalue(ST.anova_oneway(far, "x", "g")).first()
    assert r["f_statistic"] > 2735 and r["p_value"] == 0.0 and r["significant"]
    # F(1, 18) = 4.0 has the tail 0.060831 (tables give 4.41 at 5 %)
    near = spark.createDataFrame([("a", v) for v in (1.0, 3.0) * 5] + [("b", v) for v in (2.0, 4.0) * 5], "g string, x double")
    q = ST.with_anova_pvalue(ST.anova_oneway(near, "x", "g")).first()
    assert not q["significant"] or q["f_statistic"] > 4.41


def test_forecast_edges(spark):
    from ledgerscope.operators import forecast as FC
    fc = spark.createDataFrame([("S", h, float(h)) for h in range(1, 8)], "segment string, h long, yhat double")
    r = FC.forecast_summary(fc).first()
    assert (r["first_half_mean"], r["second_half_mean"]) == (2.0, 5.5)
    s = spark.sql("SELECT 'S' AS segment, DATE '2020-01-01' AS date, CAST(NULL AS DOUBLE) AS value UNION ALL SELECT 'S', DATE '2020-01-02', 1.0D")
    assert FC.as_arrays(s).first()["n"] == 1


def test_string_keys_with_one_prefix_spread_over_buckets(spark):
    """Keys are cut whole, so a long common prefix does not send every row into one bucket."""
    from ledgerscope.operators import ranking as RK
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        names = [f"customer-number-{i:05d}-é" for i in range(3000)]
        df = spark.createDataFrame([(n, 1.0) for n in names] + [(None, 1.0)], "k string, v double")
        cuts = RK._cuts(df, F.col("k"), True, 40)
        assert 30 <= len(cuts) <= 39
        counts = df.groupBy(RK._bucket_of(F.col("k"), cuts).alias("b")).count().where("b IS NOT NULL").collect()
        assert len(counts) >= 30 and max(r["count"] for r in counts) < 400
        got = RK.running_sums(df, "k", ["v"]).orderBy(F.col("k").asc_nulls_first()).collect()
        assert [r.run_v for r in got] == [float(i) for i in range(1, 3002)]
        rows = RK._bucket_of(F.col("x"), [1.0, 2.0, 5.0, 7.0, 7.5])
        xs = [0.0, 1.0, 1.5, 2.0, 6.0, 7.0, 7.2, 7.5, 9.0]
        found = spark.createDataFrame([(x,) for x in xs], "x double").select(rows.alias("b")).collect()
        assert [r.b for r in found] == [sum(c < x for c in (1.0, 2.0, 5.0, 7.0, 7.5)) for x in xs]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
