"""Queries: MLlib fits, sweeps, sinks and sources, unions (SURVEY 2.1,
2.9, 2.12). MLlib outputs have no SQL restatement (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.functions.expr import half_up
from ledgerscope.operators import features as FT
from ledgerscope.operators import forecast as FC
from ledgerscope.operators import metrics as MT
from ledgerscope.operators import models as MD
from ledgerscope.operators import stats as ST
from ledgerscope.plans import sqlkit as Q
from ledgerscope.plans.q_features import FEAT, feature_table as features
from ledgerscope.plans.q_forecast import ALL, ALL_B, metrics, series
from ledgerscope.plans.q_misc import SPLIT, split, stratified_split
from ledgerscope.plans.registry import entries, register
from ledgerscope.session import materialize, side_by_side
from ledgerscope.sources import ledger as L
from ledgerscope.sources import results as R

FEATURE_COLS = ", ".join(MD.FEATURES)
TRAIN_SQL = FEAT.rstrip() + ",\n" + SPLIT + "\n"


def _feat(spark, sf):
    return features(spark, sf).select("customer_id", "segment", "risk_tier", *MD.FEATURES)


@register("standardize", sql=FEAT + "SELECT customer_id, " + ", ".join(
    f"{Q.hu(f'CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END', 6)} AS {c}"
    for c in MD.FEATURES) + " FROM features")
def standardize(spark, sf):
    z = MD.standardize(_feat(spark, sf))
    return z.select("customer_id", *[half_up(c, 6).alias(c) for c in MD.FEATURES])


def fitted(spark, sf, models=("logistic_regression", "random_forest")):
    return MD.fit_classifiers(split(spark, sf), models=models)


@register("fit_logistic")
def fit_logistic(spark, sf):
    preds, _ = fitted(spark, sf, ("logistic_regression",))
    return MT.classification_report(preds.where(F.col("model") == "logistic_regression"))


@register("logistic_certificate", sql=TRAIN_SQL + """
SELECT (SELECT count(*) FROM split WHERE split = 'train' AND risk_tier IS NOT NULL) AS n_train, CAST(3 AS BIGINT) AS n_classes,
       TRUE AS optimal, TRUE AS below_uniform""")
def logistic_certificate(spark, sf):
    """The fitted weights against the conditions of the optimum: the gradient of the penalised loss
    over all training rows is zero to 1e-4, and the loss lies below that of equal chances."""
    train = MD._label(split(spark, sf).where(F.col("split") == "train"))
    z = materialize(MD.standardize(train.select("customer_id", "label", *MD.FEATURES)))
    lr = MD.fit_logistic(z)
    c = MD.logistic_certificate(z, lr.coefficientMatrix.toArray(), lr.interceptVector.toArray())
    return c.select("n_train", "n_classes", (F.col("gradient_norm") < 1e-4).alias("optimal"), (F.col("loss") < 1.0986122886681098).alias("below_uniform"))


@register("fit_random_forest")
def fit_random_forest(spark, sf):
    preds, _ = fitted(spark, sf, ("random_forest",))
    return MT.classification_report(preds.where(F.col("model") == "random_forest"))


@register("predict_classes")
def predict_classes(spark, sf):
    preds, _ = fitted(spark, sf)
    return preds


@register("feature_importance")
def feature_importance(spark, sf):
    _, rf = fitted(spark, sf, ("random_forest",))
    return MD.importances(rf, spark)


@register("topk_feature_importance")
def topk_feature_importance(spark, sf):
    _, rf = fitted(spark, sf, ("random_forest",))
    # a top-k report: the limit is the feature (11 rows in)
    return MD.importances(rf, spark).orderBy(F.desc("importance"), "feature").limit(5)


@register("leakage_guard")
def leakage_guard(spark, sf):
    preds, _ = fitted(spark, sf)
    acc = preds.groupBy("model").agg(
        (F.count_if(F.col("actual") == F.col("predicted")) / F.count(F.lit(1))).alias("accuracy"))
    return acc.select("model", half_up("accuracy", 4).alias("accuracy"),
                      (F.col("accuracy") > 0.97).alias("suspicious"),
                      F.lit(",".join(MD.FEATURES)).alias("inputs"),
                      F.lit("_fhs_mean" not in MD.FEATURES).alias("leakage_column_excluded"))


@register("best_f1_model")
def best_f1_model(spark, sf):
    preds, _ = fitted(spark, sf)
    rows = []
    for m in ("logistic_regression", "random_forest"):
        rep = MT.classification_report(preds.where(F.col("model") == m))
        rows.append(rep.where(F.col("class") == "macro avg").select(F.lit(m).alias("model"), "f1"))
    both = rows[0].unionByName(rows[1])
    prio = F.when(F.col("model") == "logistic_regression", 0).otherwise(1)
    return both.agg(F.max_by("model", F.struct("f1", -prio)).alias("best_model"), F.max("f1").alias("macro_f1"))


@register("model_reports")
def model_reports(spark, sf):
    """Report of both models from one fit; the class supports add up to the test set."""
    return reports(fitted(spark, sf)[0])


def reports(preds):
    parts = [MT.classification_report(preds.where(F.col("model") == m)).select(F.lit(m).alias("model"), "*")
             for m in ("logistic_regression", "random_forest")]
    return parts[0].unionByName(parts[1])


def forest_scores(spark, sf):
    """One-vs-rest rows of the forest's test predictions: class, is_pos, score."""
    preds = fitted(spark, sf, ("random_forest",))[0]
    rows = preds.select("actual", F.posexplode("probability").alias("k", "score"))
    names = F.array(*[F.lit(c) for c in MD.CLASSES])
    cls = F.element_at(names, F.col("k") + 1)
    return materialize(rows.select(cls.alias("class"), (F.col("actual") == cls).cast("int").alias("is_pos"), "score"))


@register("forest_confusion")
def forest_confusion(spark, sf):
    return MT.confusion(fitted(spark, sf, ("random_forest",))[0])


@register("forest_roc_auc")
def forest_roc_auc(spark, sf):
    return MT.roc_auc(forest_scores(spark, sf))


@register("forest_roc_curve")
def forest_roc_curve(spark, sf):
    return MT.thin_curve(MT.roc_curve(forest_scores(spark, sf)))


@register("kmeans_sweep")
def kmeans_sweep(spark, sf):
    return MD.kmeans_sweep(_feat(spark, sf))


@register("silhouette")
def silhouette(spark, sf):
    return MD.kmeans_sweep(_feat(spark, sf)).select("k", "silhouette")


@register("argmax_k")
def argmax_k(spark, sf):
    return MD.best_k(MD.kmeans_sweep(_feat(spark, sf)))


def final_labels(spark, sf):
    return MD.kmeans_labels(_feat(spark, sf))


@register("kmeans_final")
def kmeans_final(spark, sf):
    return final_labels(spark, sf)


def crosstab(df, row: str, col: str):
    """Contingency counts in long form with every (row, col) cell present
    (zeros filled); the cell grid is rows x cols distinct values (bounded
    by the label sets, broadcast)."""
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    cells = df.select(row).distinct().crossJoin(F.broadcast(df.select(col).distinct()))
    return cells.join(counts, [row, col], "left").select(
        row, col, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@register("cluster_crosstab", sql=FEAT + """
SELECT s.segment, t.risk_tier, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT segment FROM features) s CROSS JOIN (SELECT DISTINCT risk_tier FROM features) t
LEFT JOIN (SELECT segment, risk_tier, count(*) AS n FROM features GROUP BY segment, risk_tier) c
  ON c.segment = s.segment AND c.risk_tier = t.risk_tier""")
def cluster_crosstab(spark, sf):
    """segment x given label (the risk tier here); the k-means labels use
    the same operator in ``kmeans_crosstab``."""
    return crosstab(features(spark, sf), "segment", "risk_tier")


@register("kmeans_crosstab")
def kmeans_crosstab(spark, sf):
    return crosstab(final_labels(spark, sf), "segment", "cluster")


def _power_sql() -> str:
    """Principal components by power iteration with deflation: another way to the same eigenpairs."""
    z = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END" for c in MD.FEATURES)
    n = len(MD.FEATURES)
    cells = ", ".join("[" + ", ".join(f"covar_pop(v[{i}], v[{j}])" for j in range(1, n + 1)) + "]" for i in range(1, n + 1))
    start = "[" + ", ".join(repr(1.0 + 0.37 * k) for k in range(n)) + "]"

    def power(name: str, matrix: str) -> str:
        return f"""{name}(i, m, v) AS (
  SELECT 0, m, CAST({start} AS DOUBLE[]) FROM {matrix}
  UNION ALL SELECT i + 1, m, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (
    SELECT i, m, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM {name} WHERE i < 4000)),
{name}_v AS (SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS val FROM {name} WHERE i = 4000)"""

    sign = "list_transform(v, lambda x: x * CASE WHEN v[list_position(list_transform(v, lambda y: abs(y)), list_aggregate(list_transform(v, lambda y: abs(y)), 'max'))] < 0 THEN -1.0 ELSE 1.0 END)"
    return FEAT.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
zs AS (SELECT customer_id, segment, [{z}] AS v FROM features),
cv AS (SELECT [{cells}] AS m FROM zs),
{power("p1", "cv")},
cv2 AS (SELECT list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: m[i][j] - val * v[i] * v[j])) AS m FROM p1_v),
{power("p2", "cv2")},
pc AS (SELECT a.v AS v1, b.v AS v2, a.val AS l1, b.val AS l2 FROM (SELECT {sign} AS v, val FROM p1_v) a, (SELECT {sign} AS v, val FROM p2_v) b),
tr AS (SELECT list_sum(list_transform(range(1, {n + 1}), lambda i: m[i][i])) AS t FROM cv)
"""


@register("pca_2d", sql=_power_sql() + """
SELECT customer_id, segment, floor(list_dot_product(v, v1) * 10000.0 + 0.5) / 10000.0 AS x, floor(list_dot_product(v, v2) * 10000.0 + 0.5) / 10000.0 AS y,
       floor(l1 / t * 10000.0 + 0.5) / 10000.0 AS variance_pc1, floor(l2 / t * 10000.0 + 0.5) / 10000.0 AS variance_pc2 FROM zs, pc, tr""")
def pca_2d(spark, sf):
    """Points on the first two components and the variance share of each."""
    pts, var = MD.pca_2d(_feat(spark, sf))
    shares = {f"variance_pc{k}": half_up(F.lit(v), 4) for k, v in enumerate(var, 1)}
    return pts.withColumns(shares)


@register("pca_clusters")
def pca_clusters(spark, sf):
    """The plotted points with their cluster."""
    f = _feat(spark, sf)
    return MD.pca_2d(f)[0].join(MD.kmeans_labels(f).drop("segment"), "customer_id")


_Z = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END AS {c}" for c in MD.FEATURES)
_DIST = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in MD.FEATURES)


@register("silhouette_tiers", sql=FEAT.rstrip() + f""",
zt AS (SELECT customer_id, risk_tier AS c, {_Z} FROM features),
pd AS (SELECT p.customer_id, p.c, q.c AS other, sum(sqrt({_DIST})) AS d, count(*) AS n FROM zt p CROSS JOIN zt q GROUP BY ALL),
ab AS (SELECT customer_id, max(CASE WHEN c = other THEN d / nullif(n - 1, 0) END) AS a, max(CASE WHEN c = other THEN n END) AS n_own,
   min(CASE WHEN c <> other THEN d / n END) AS b FROM pd GROUP BY customer_id)
SELECT count(*) AS n, (SELECT count(DISTINCT c) FROM zt) AS n_clusters,
  {Q.hu("avg(CASE WHEN n_own = 1 OR b IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END)", 4)} AS silhouette FROM ab""")
def silhouette_tiers(spark, sf):
    """Mean Euclidean silhouette of the risk tiers on the z-scored features."""
    return MD.euclidean_silhouette(MD.standardize(_feat(spark, sf)), "risk_tier")


# ---- sinks and sources ---------------------------------------------------------

@register("src_panel_csv", sql=Q.with_(*Q.panel_ctes("lines")) + "SELECT * FROM panel")
def src_panel_csv(spark, sf):
    path = R.results_base(spark) + "/panel_csv"
    R.write_runs_csv(L.line_runs(spark, sf), path)
    return R.read_panel_csv(spark, path)


# a foreign file: some customers' dates in another format, some days twice, some days left out
DAMAGED = Q.with_(*Q.panel_ctes("lines"), """marked AS (SELECT *, customer_id % 50 AS k, day(date) AS dom FROM panel
  WHERE date > (SELECT max(date) FROM panel) - 200)""",
                  "edges AS (SELECT customer_id, min(date) AS lo, max(date) AS hi FROM marked WHERE k = 2 AND dom <> 10 GROUP BY customer_id)")


@register("src_panel_quarantine", sql=DAMAGED + """
SELECT 'accepted' AS status, count(*) AS n FROM marked WHERE NOT (k = 0 AND dom < 5) AND NOT (k = 2 AND dom = 10)
UNION ALL SELECT 'malformed', count(*) FROM marked WHERE k = 0 AND dom < 5
UNION ALL SELECT 'duplicate', count(*) FROM marked WHERE k = 1 AND dom = 15
UNION ALL SELECT 'gap_day', (SELECT count(*) FROM marked m JOIN edges e USING (customer_id) WHERE dom = 10 AND date > lo AND date < hi)
  + (SELECT coalesce(sum(g), 0) FROM (SELECT customer_id, count(*) FILTER (WHERE dom < 5 AND date > x AND date < y) AS g
     FROM marked JOIN (SELECT customer_id, min(date) FILTER (WHERE dom >= 5) AS x, max(date) FILTER (WHERE dom >= 5) AS y
                       FROM marked WHERE k = 0 GROUP BY customer_id) USING (customer_id) WHERE k = 0 GROUP BY customer_id))""")
def src_panel_quarantine(spark, sf):
    """Accepted and rejected rows of a foreign balance CSV (the last 200 days, damaged by a fixed rule)."""
    path = R.results_base(spark) + "/foreign_csv"
    p = L.line_panel(spark, sf, keep_last=200).withColumns({"k": F.col("customer_id") % 50, "dom": F.day("date")})
    p = p.where(~((F.col("k") == 2) & (F.col("dom") == 10)))
    day = F.when((F.col("k") == 0) & (F.col("dom") < 5), F.date_format("date", "dd/MM/yyyy")).otherwise(F.col("date").cast("string"))
    twice = F.array(F.col("balance"), F.col("balance") + 1)
    once = F.when((F.col("k") == 1) & (F.col("dom") == 15), twice).otherwise(F.array("balance"))
    R.write_csv(p.select("customer_id", "segment", day.alias("date"), F.explode(once).alias("balance")), path)
    return R.quarantine_counts(R.scan_panel_csv(spark, path))


@register("src_panel_table", sql=Q.with_(*Q.panel_ctes("lines")) + "SELECT * FROM panel")
def src_panel_table(spark, sf):
    """The panel written once as a bucketed, sorted table and read back;
    per-customer operators on it run without an exchange."""
    from ledgerscope.sources.panel_store import panel_buckets, save_runs_as_panel
    days = L.calendar_bounds(L.line_dates(spark, sf)).select(F.datediff("d_end", "d_start") + 1).first()[0] or 0
    rows = L.accounts(spark, sf).count() * days
    runs = L.line_runs(spark, sf, parts=panel_buckets(spark, rows))
    return save_runs_as_panel(runs, rows, name="ledgerscope_line_panel", dealt=True)


@register("sink_features_csv", sql=FEAT + "SELECT * FROM features")
def sink_features_csv(spark, sf):
    """The feature table written as CSV and read back with its types."""
    path = R.results_base(spark) + "/features_csv"
    f = features(spark, sf)
    R.write_csv(f, path)
    return spark.read.schema(f.schema).option("header", True).csv(path)


@register("sink_results_json", sql=ALL_B + "SELECT * FROM bmet")
def sink_results_json(spark, sf):
    """The forecast document written as JSON lines and read back with its schema."""
    base = R.results_base(spark)
    R.write_docs({"forecast_metrics": metrics(spark, sf)}, base)
    return R.read_doc(spark, base, "forecast_metrics")


@register("src_results_json", sql=ALL_B + """
SELECT 'forecast_metrics' AS doc, segment, model, field, CAST(value AS DOUBLE) AS value FROM (
  SELECT segment, model, rmse, mae, mape, CAST(n_test AS DOUBLE) AS n_test FROM bmet)
UNPIVOT (value FOR field IN (rmse, mae, mape, n_test))
UNION ALL SELECT doc, NULL, NULL, NULL, NULL
FROM (VALUES ('classification_report'), ('clustering'), ('statistical_tests')) t(doc)""")
def src_results_json(spark, sf):
    """The expected documents parsed into (segment, model, field, value) rows; an absent one is a row of nulls."""
    base = R.results_base(spark)
    R.write_docs({"forecast_metrics": metrics(spark, sf)}, base)
    doc = R.read_doc(spark, base, "forecast_metrics")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"))
                       for c in ("rmse", "mae", "mape", "n_test")])
    rows = doc.select(F.lit("forecast_metrics").alias("doc"), "segment", "model", F.explode(fields).alias("f")).select(
        "doc", "segment", "model", "f.field", "f.value")
    return R.doc_status(spark, base).select("doc").join(rows, "doc", "left")


@register("results_status", sql=ALL_B + """
SELECT t.doc, CASE WHEN t.doc = 'forecast_metrics' THEN CAST((SELECT count(*) FROM bmet) AS DOUBLE) END AS n_accepted,
       CASE WHEN t.doc = 'forecast_metrics' THEN CAST(1 AS DOUBLE) END AS n_rejected
FROM (VALUES ('classification_report'), ('clustering'), ('forecast_metrics'), ('statistical_tests')) t(doc)""")
def results_status(spark, sf):
    """Accepted and rejected lines of the expected documents: one was written, with a line that does not parse."""
    base = R.results_base(spark)
    doc = metrics(spark, sf)
    R.write_docs({"forecast_metrics": doc}, base)
    spark.range(1).select(F.lit("{cut off").alias("value")).write.mode("append").text(f"{base}/forecast_metrics")
    return R.doc_status(spark, base).select("doc", *[F.col(c).cast("double").alias(c) for c in ("n_accepted", "n_rejected")])


@register("results_documents")
def results_documents(spark, sf):
    """All four result documents, written and parsed: (doc, field, value) rows."""
    from ledgerscope.plans.q_misc import significance
    base = R.results_base(spark)
    f = features(spark, sf)
    # each document needs the features at most; predictions are taken once for both reports
    docs = {"classification_report": lambda: reports(materialize(MD.fit_classifiers(stratified_split(f))[0])),
            "clustering": lambda: MD.kmeans_sweep(f.select("customer_id", "segment", "risk_tier", *MD.FEATURES)),
            "forecast_metrics": lambda: metrics(spark, sf),
            "statistical_tests": lambda: significance(f)}
    side_by_side(spark, *[lambda name=name, doc=doc: R.write_docs({name: doc()}, base) for name, doc in docs.items()])
    return R.read_docs(spark, base, R.RESULT_DOCS)


# ---- unions ------------------------------------------------------------------------

@register("union_dates", sql=ALL + """
SELECT segment, date FROM series UNION SELECT segment, ds AS date FROM fc""")
def union_dates(spark, sf):
    s = series(spark, sf)
    fc = FC.forecast_all(s)
    return s.select("segment", "date").union(fc.select("segment", F.col("ds").alias("date"))).distinct()


@register("union_all_customers", sql=Q.with_(Q.flows_cte("lines", "lf"), Q.flows_cte("orders", "of")) + """
SELECT 'lines' AS source, customer_id, d AS date, CAST(amount AS DOUBLE) AS amount FROM lf
UNION ALL SELECT 'orders', customer_id, d, CAST(amount AS DOUBLE) FROM of""")
def union_all_customers(spark, sf):
    a = L.line_ledger(spark, sf).withColumn("source", F.lit("lines"))
    b = L.order_ledger(spark, sf).withColumn("source", F.lit("orders"))
    u = a.unionByName(b)
    return u.select("source", "customer_id", "date", F.col("amount").cast("double").alias("amount"))


# ---- all offline steps over one feature table -----------------------------------------

def run_risk_pipeline(spark, sf) -> dict:
    """Every offline step by name, as DataFrames over one feature table.

    The feature table is computed once and written as a bucketed table; tiers,
    fits, clustering and tests read that table, the backtest reads the daily
    score series. The classifiers and the sweep are fitted here and the backtest is run (Spark jobs,
    side by side); everything else is lazy.
    """
    from ledgerscope.plans.q_features import features as lazy_features
    from ledgerscope.plans.q_misc import significance
    from ledgerscope.sources.panel_store import save_table
    f = save_table(lazy_features(spark, sf), "risk_features")

    def classified():
        preds, forest = MD.fit_classifiers(stratified_split(f))
        return materialize(preds), forest

    (preds, forest), fits, errors = side_by_side(
        spark, classified, lambda: MD.kmeans_models(f.select("customer_id", "segment", "risk_tier", *MD.FEATURES)),
        lambda: materialize(metrics(spark, sf)))
    sweep = MD.kmeans_sweep(f, models=fits)
    accuracy = preds.groupBy("model").agg(
        half_up(F.count_if(F.col("actual") == F.col("predicted")) / F.count(F.lit(1)), 4).alias("accuracy"))
    return {
        "features": f,
        "tier_distribution": FT.tier_distribution(f), "segment_summary": FT.segment_summary(f),
        "accuracy": accuracy.withColumn("leakage", (F.col("accuracy") > 0.97).cast("int")),
        "classification_report": reports(preds).withColumn("item", F.concat_ws("/", "model", "class")),
        "confusion": MT.confusion(preds.where("model = 'random_forest'")).withColumn("item", F.concat_ws("/", "actual", "predicted")),
        "feature_importance": MD.importances(forest, spark),
        "kmeans_sweep": sweep, "best_k": MD.best_k(sweep),
        "cluster_crosstab": crosstab(MD.kmeans_labels(f.select("customer_id", "segment", *MD.FEATURES), models=fits), "segment", "cluster").withColumn(
            "item", F.concat_ws("/", "segment", "cluster")),
        "forecast_metrics": errors.withColumn("item", F.concat_ws("/", "segment", "model")),
        "backtest_summary": FC.backtest_summary(errors),
        "anova_oneway": ST.anova_oneway(f, "_fhs_mean", "segment"), "spearman": ST.spearman(f, "runway_mean", "_fhs_mean"),
        "significance_tests": significance(f),
    }


PIPELINE_ROWS = [
    ("tier_distribution", "risk_tier", ["n_customers"]), ("segment_summary", "segment", ["mean_fhs", "std_fhs", "n_customers", "pct_high_risk"]),
    ("accuracy", "model", ["accuracy", "leakage"]), ("classification_report", "item", ["precision", "recall", "f1", "support"]),
    ("confusion", "item", ["n"]), ("feature_importance", "feature", ["importance"]), ("kmeans_sweep", "k", ["inertia", "silhouette"]),
    ("best_k", "'all'", ["best_k", "best_silhouette"]), ("cluster_crosstab", "item", ["n"]), ("forecast_metrics", "item", ["rmse", "mae", "mape"]),
    ("backtest_summary", "'all'", ["hw_wins", "n_segments", "avg_rmse_improvement_pct"]), ("anova_oneway", "'all'", ["f_statistic", "eta_squared", "n"]),
    ("spearman", "'all'", ["rho", "n"]), ("significance_tests", "test", ["statistic", "p_value"])]


def long_rows(tables: dict, steps):
    """(step, item, field, value) of the named tables."""
    out = None
    for step, item, fields in steps:
        key = F.lit(item.strip("'")) if item.startswith("'") else F.col(item).cast("string")
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in fields])
        rows = tables[step].select(F.lit(step).alias("step"), key.alias("item"), F.explode(pairs).alias("p")).select(
            "step", "item", "p.field", "p.value")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("run_risk_pipeline")
def risk_pipeline(spark, sf):
    """All steps as one table; ``risk_suite`` holds those that SQL can restate."""
    return long_rows(run_risk_pipeline(spark, sf), PIPELINE_ROWS)


def _long(step: str, item: str, fields: list[str], sql: str) -> str:
    parts = [f"SELECT '{step}' AS step, CAST({item} AS VARCHAR) AS item, '{c}' AS field, CAST({c} AS DOUBLE) AS value FROM s"
             for c in fields]
    return f"SELECT * FROM (WITH s AS (SELECT * FROM ({sql})) " + " UNION ALL ".join(parts) + ")"


STEPS = [("tier_distribution", "risk_tier", ["n_customers"]),
         ("segment_summary", "segment", ["mean_fhs", "std_fhs", "n_customers", "pct_high_risk"]),
         ("anova_oneway", "'all'", ["f_statistic", "n"]),
         ("spearman", "'all'", ["rho", "n"]),
         ("backtest_summary", "'all'", ["hw_wins", "n_segments", "avg_rmse_improvement_pct"])]


def _suite_sql() -> str:
    known = entries()
    return " UNION ALL ".join(_long(step, item, fields, known[step].sql) for step, item, fields in STEPS)


@register("risk_suite", sql=_suite_sql())
def risk_suite(spark, sf):
    """The offline steps that SQL can restate, as one table of (step, item,
    field, value); the feature table is built once and shared."""
    f = features(spark, sf)
    return long_rows({"tier_distribution": FT.tier_distribution(f), "segment_summary": FT.segment_summary(f),
                      "anova_oneway": ST.anova_oneway(f, "_fhs_mean", "segment"),
                      "spearman": ST.spearman(f, "runway_mean", "_fhs_mean"),
                      "backtest_summary": FC.backtest_summary(metrics(spark, sf))}, STEPS)
