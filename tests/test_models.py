"""Batched Lloyd, Euclidean silhouette, Jacobi eigenpairs against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import models as MD

COLS = ["a", "b", "c"]


def points(spark, seed, n, groups=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.4, (n, 3)) + rng.normal(0, 3, (groups, 3))[rng.integers(0, groups, n)]
    df = spark.createDataFrame([(i, f"g{i % 3}", *map(float, r)) for i, r in enumerate(x)], "customer_id bigint, label string, a double, b double, c double")
    return x, df.repartition(3)


def slow_lloyd(x, c):
    c = c.copy()
    while True:
        at = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        cost = ((x - c[at]) ** 2).sum()
        new = np.array([np.round(x[at == k].mean(axis=0), 9) if (at == k).any() else c[k] for k in range(len(c))])
        if np.array_equal(new, c):
            return cost, c
        c = new


def test_all_models_advance_as_each_would_alone(spark):
    x, df = points(spark, 1, 400)
    starts = {(k, r): MD.spread_seeds(x, k, 7 * k + r) for k in (1, 2, 4, 5) for r in range(3)}
    got = MD.lloyd(df, starts, COLS)
    for m, start in starts.items():
        cost, c = slow_lloyd(x, start)
        assert abs(got[m][0] - cost) < 1e-6 * cost and np.allclose(got[m][1], c, atol=1e-8)


def test_labels_are_the_nearest_centres(spark):
    x, df = points(spark, 2, 100)
    c = MD.spread_seeds(x, 3, 1)
    rows = MD.with_labels(df, {"k": c}, COLS).select("customer_id", "k").collect()
    want = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert all(r.k == want[r.customer_id] for r in rows)


def slow_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = y == y[i]
        others = [d[i, y == v].mean() for v in set(y) if v != y[i]]
        if own.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_silhouette_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(MD, "BLOCK_ROWS", block)
    x, df = points(spark, 3, 60)
    df = df.withColumn("label", F.when(F.col("customer_id") == 5, "alone").otherwise(F.col("label")))
    y = np.array(["alone" if i == 5 else f"g{i % 3}" for i in range(60)])
    extra = spark.createDataFrame([(99, None, 1.0, 1.0, 1.0)], df.schema)
    r = MD.euclidean_silhouette(df.union(extra), "label", COLS).first()
    assert (r.n, r.n_clusters) == (60, 4) and abs(r.silhouette - slow_silhouette(x, y)) < 1e-4


def test_one_cluster_or_no_rows(spark):
    _, df = points(spark, 4, 10)
    one = MD.euclidean_silhouette(df.withColumn("label", F.lit("x")), "label", COLS).first()
    assert (one.n, one.n_clusters, one.silhouette) == (10, 1, 0.0)
    none = MD.euclidean_silhouette(df.where("customer_id < 0"), "label", COLS).first()
    assert (none.n, none.n_clusters, none.silhouette) == (0, 0, None)


def test_jacobi_eigenpairs():
    rng = np.random.default_rng(5)
    for n in (1, 2, 11):
        m = rng.normal(size=(n, n))
        m = m @ m.T
        values, vectors = MD.jacobi_eigenpairs(m)
        assert np.allclose(m @ vectors, vectors * values, atol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
        assert (np.diff(values) <= 1e-12).all() and np.allclose(values, np.linalg.eigvalsh(m)[::-1])
        assert all(v[np.abs(v).argmax()] > 0 for v in vectors.T)
    assert np.allclose(MD.jacobi_eigenpairs(np.zeros((3, 3)))[0], 0)


def test_covariance_is_one_aggregate(spark):
    x, df = points(spark, 6, 50)
    assert np.allclose(MD.covariance(df, COLS), np.cov(x.T, bias=True))


def test_logistic_certificate_tells_the_optimum(spark):
    """At the fitted weights the gradient vanishes; moved weights do not pass. Loss and gradient against numpy."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, len(MD.FEATURES)))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0).astype(int) + (x[:, 1] > 0.8)
    train = spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, x)], "label double, " + ", ".join(f"{c} double" for c in MD.FEATURES))
    lr = MD.fit_logistic(train)
    w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()

    def direct(w, b):
        m = x @ w.T + b
        p = np.exp(m - m.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        r = p - np.eye(3)[y]
        g = np.concatenate([((r.T @ x + w) / len(x)).ravel(), r.mean(axis=0)])
        return -np.log(p[np.arange(len(x)), y]).mean() + (w ** 2).sum() / 2 / len(x), np.linalg.norm(g)

    for dw in (0.0, 0.05):
        got = MD.logistic_certificate(train, w + dw * np.eye(*w.shape), b).first()
        loss, norm = direct(w + dw * np.eye(*w.shape), b)
        assert (got.n_train, got.n_classes) == (300, 3) and abs(got.loss - loss) < 1e-9 and abs(got.gradient_norm - norm) < 1e-9
        assert (got.gradient_norm < 1e-4) == (dw == 0.0)


def test_passes_have_tasks_by_their_rows(spark, monkeypatch):
    """The sweep's many passes read as many partitions as the rows fill, not as many as the feature table came in."""
    rng = np.random.default_rng(3)
    rows = [(i, "s", *map(float, rng.normal(0, 1, len(MD.FEATURES)))) for i in range(300)]
    f = spark.createDataFrame(rows, "customer_id bigint, segment string, " + ", ".join(f"{c} double" for c in MD.FEATURES)).repartition(40)
    seen = []

    def watched(z, models, **more):
        seen.append(z.rdd.getNumPartitions())
        return real(z, models, **more)

    real = MD.lloyd
    monkeypatch.setattr(MD, "lloyd", watched)
    assert set(MD.kmeans_models(f, ks=(2, 3), restarts=2)) == {2, 3}
    monkeypatch.setattr(MD, "TASK_ROWS", 100)
    MD.kmeans_models(f, ks=(2,), restarts=1)
    assert seen == [1, 3]


def test_passes_shuffle_nothing_and_reruns_agree(spark, monkeypatch):
    """Every pass is one stage: its tasks send their sums, nothing is dealt by model and cluster."""
    x, df = points(spark, 11, 500)
    df = df.repartition(4, "customer_id").cache()
    starts = {(k, r): MD.spread_seeds(x, k, k + r) for k in (2, 3, 5) for r in range(2)}
    plain = MD.lloyd(df, starts, COLS)
    monkeypatch.setattr(MD.DataFrame, "groupBy", None)
    again = MD.lloyd(df, starts, COLS)
    assert all(plain[m][0] == again[m][0] and np.array_equal(plain[m][1], again[m][1]) for m in starts)


def test_ties_go_to_the_lower_centre_and_empty_clusters_stay(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 0.0, 0.0)], "a double, b double, c double")
    start = np.array([[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [9.0, 9.0, 9.0]])
    cost, centres = MD.lloyd(df, {"m": start}, COLS)["m"]
    assert cost == 2.0 and np.array_equal(centres, start)


def test_a_pass_is_one_wave_of_tasks(spark, monkeypatch):
    """However many rows there are, a pass has no more tasks than cores; the sweep's rows need no Python worker to be read."""
    rng = np.random.default_rng(4)
    rows = [(i, "s", *map(float, rng.normal(0, 1, len(MD.FEATURES)))) for i in range(300)]
    f = spark.createDataFrame(rows, "customer_id bigint, segment string, " + ", ".join(f"{c} double" for c in MD.FEATURES)).repartition(40)
    seen, real = [], MD.lloyd

    def watched(z, models, **more):
        seen.append(z.rdd.getNumPartitions())
        return real(z, models, **more)

    monkeypatch.setattr(MD, "lloyd", watched)
    monkeypatch.setattr(MD, "TASK_ROWS", 10)
    models = MD.kmeans_models(f, ks=(2, 3), restarts=2)
    assert seen == [spark.sparkContext.defaultParallelism]
    sweep = MD.kmeans_sweep(f, models)
    assert "ExistingRDD" not in sweep._jdf.queryExecution().executedPlan().toString()
    assert [(r.k, r.inertia) for r in sweep.orderBy("k").collect()] == [(k, round(models[k][0], 2)) for k in (2, 3)]
    assert MD.kmeans_sweep(f, {}).count() == 0


def test_moments_and_costs_of_all_clusters_at_once():
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(50, 3)), rng.normal(size=(4, 5, 3))
    (k, at), = MD._assign(x, {5: c})
    d = ((x[None, None] - c[:, :, None]) ** 2).sum(axis=3)
    assert k == 5 and np.array_equal(at, d.argmin(axis=1))
    for m in range(4):
        for j in range(5):
            own = x[at[m] == j]
            assert np.allclose(MD._moments(x, at, c)[m, j], [len(own), *own.sum(axis=0)])
            assert np.allclose(MD._costs(x, at, c)[m, j], ((own - c[m, j]) ** 2).sum())


def test_silhouette_of_copies_and_a_row_far_away(spark):
    """Rows at the same place have distance 0 whatever the lengths of the vectors are."""
    x = np.array([[3.1, 4.7, 1e3]] * 3 + [[-2.3, 0.9, 1e3], [1e4, 0.1, 0.7]])
    y = ["a", "a", "b", "c", "c"]
    df = spark.createDataFrame([(i, y[i], *map(float, r)) for i, r in enumerate(x)], "customer_id bigint, label string, a double, b double, c double")
    r = MD.euclidean_silhouette(df, "label", COLS).first()
    assert (r.n, r.n_clusters) == (5, 3) and abs(r.silhouette - slow_silhouette(x, np.array(y))) < 1e-4


def test_silhouette_shuffles_a_row_once_per_group(spark, monkeypatch):
    """The copies of a row follow the cores, not the square of the rows, and one task has one pair of groups."""
    monkeypatch.setattr(MD, "BLOCK_ROWS", 4)
    x, df = points(spark, 8, 600)
    got = MD.euclidean_silhouette(df, "label", COLS)
    y = np.array([f"g{i % 3}" for i in range(600)])
    assert abs(got.first().silhouette - slow_silhouette(x, y)) < 1e-4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    groups = int(np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism)))
    assert "RepartitionByExpression [pair" in plan and f", {groups * (groups + 1) // 2}" in plan, plan
