"""Fits over the feature table: MLlib classifiers, k-means sweep, PCA, silhouettes.

Fits are the only eager steps of the library (MLlib estimators and Lloyd's
iterations run their own distributed jobs). Inputs are assembled with ``VectorAssembler``; the
z-score uses the population standard deviation, as the reference does,
computed by one aggregate and broadcast as a one-row table.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerscope.functions.expr import half_up
from ledgerscope.params import DEFAULT_PARAMS
from ledgerscope.session import materialize as _cut, side_by_side

FEATURES = list(DEFAULT_PARAMS.feature_columns)
CLASSES = ("High", "Low", "Medium")      # alphabetical = label index


def standardize(df: DataFrame, cols=FEATURES, fit_on: DataFrame | None = None) -> DataFrame:
    """z = (x - mean) / pop std; constant columns give 0."""
    src = fit_on if fit_on is not None else df
    stats = src.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                    *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(stats))
    z = [F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
         .otherwise(F.lit(0.0)).alias(c) for c in cols]
    keep = [c for c in df.columns if c not in cols]
    return j.select(*keep, *z)


def _label(df: DataFrame) -> DataFrame:
    """Class index; rows without a tier carry no label and are left out."""
    idx = F.when(F.col("risk_tier") == CLASSES[0], 0.0).when(F.col("risk_tier") == CLASSES[1], 1.0) \
        .when(F.col("risk_tier") == CLASSES[2], 2.0)
    return df.withColumn("label", idx).where(F.col("label").isNotNull())


def _assemble(df: DataFrame, cols=FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def fit_classifiers(split: DataFrame, seed: int = 42,
                    models=("logistic_regression", "random_forest")):
    """Logistic regression on z-scores (fitted on train) and/or a random
    forest on raw features; returns (predictions, rf_model or None)."""
    # iterative fits re-read their input many times: cut the lineage once
    # (reliable checkpoint into spark.checkpoint.dir, survives executor loss)
    split = _cut(split.select("customer_id", "risk_tier", "split", *FEATURES))
    train = _label(split.where(F.col("split") == "train"))
    test = _label(split.where(F.col("split") == "test"))
    names = F.array(*[F.lit(c) for c in CLASSES])
    fits = {"logistic_regression": lambda: fit_logistic(standardize(train, fit_on=train)),
            "random_forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed).fit(_assemble(train))}
    wanted = [m for m in fits if m in models]
    fits = dict(zip(wanted, side_by_side(split.sparkSession, *[fits[m] for m in wanted]))) if wanted else {}
    outs, rf = [], fits.get("random_forest")
    if "logistic_regression" in fits:
        ztest = _assemble(standardize(test, fit_on=train))
        outs.append(fits["logistic_regression"].transform(ztest).withColumn("model", F.lit("logistic_regression")))
    if rf is not None:
        outs.append(rf.transform(_assemble(test)).withColumn("model", F.lit("random_forest")))
    preds = None
    for o in outs:
        o = o.select("model", "customer_id", F.col("risk_tier").alias("actual"),
                     F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"),
                     vector_to_array("probability").alias("probability"))
        preds = o if preds is None else preds.unionByName(o)
    return preds, rf


def logistic_certificate(train: DataFrame, coefficients: np.ndarray, intercepts: np.ndarray, penalty: float = 1.0) -> DataFrame:
    """How close multinomial weights are to the optimum: one row of n_train, n_classes, loss and gradient norm.

    ``train`` holds the z-scored features and ``label``. The penalised mean loss is
    sum of -log p(label) / n + penalty / (2 n) * |weights|^2; at its only optimum
    the gradient is zero. Its entries are sums over the rows, taken in one aggregate:
    (p_k - [label = k]) * x_j per class and feature, and per class alone.
    """
    n_classes, cols = len(intercepts), FEATURES
    margin = [functools.reduce(lambda s, t: s + t, [F.col(c) * F.lit(float(coefficients[k, j])) for j, c in enumerate(cols)]) + F.lit(float(intercepts[k]))
              for k in range(n_classes)]
    rows = train.select("label", *cols, *[m.alias(f"_m{k}") for k, m in enumerate(margin)])
    top = F.greatest(*[F.col(f"_m{k}") for k in range(n_classes)])
    rows = rows.withColumn("_top", top)
    rows = rows.withColumn("_z", functools.reduce(lambda s, t: s + t, [F.exp(F.col(f"_m{k}") - F.col("_top")) for k in range(n_classes)]))
    own = functools.reduce(lambda e, k: e.when(F.col("label") == k, F.col(f"_m{k}")), range(1, n_classes), F.when(F.col("label") == 0, F.col("_m0")))
    rows = rows.select("label", *cols, (F.log("_z") + F.col("_top") - own).alias("_loss"), *[
        (F.exp(F.col(f"_m{k}") - F.col("_top")) / F.col("_z") - (F.col("label") == k).cast("double")).alias(f"_r{k}") for k in range(n_classes)])
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_loss").alias("loss"),
                   *[F.sum(F.col(f"_r{k}") * F.col(c)).alias(f"g{k}_{j}") for k in range(n_classes) for j, c in enumerate(cols)],
                   *[F.sum(f"_r{k}").alias(f"b{k}") for k in range(n_classes)])
    n = F.col("n").cast("double")
    parts = [((F.col(f"g{k}_{j}") + F.lit(penalty * float(coefficients[k, j]))) / n) for k in range(n_classes) for j in range(len(cols))]
    parts += [F.col(f"b{k}") / n for k in range(n_classes)]
    norm = F.sqrt(functools.reduce(lambda s, t: s + t, [g * g for g in parts]))
    weight = float(penalty * (coefficients ** 2).sum() / 2)
    return one.select(F.col("n").alias("n_train"), F.lit(n_classes).cast("bigint").alias("n_classes"),
                      ((F.col("loss") + F.lit(weight)) / n).alias("loss"), norm.alias("gradient_norm"))


def fit_logistic(train: DataFrame):
    """Multinomial logistic regression on z-scored ``train`` (features, label); MLlib averages the loss, so C = 1 on the
    summed loss is regParam = 1 / n. Inputs are z-scored already, so no second standardisation inside the fit."""
    n_train = train.count()
    return LogisticRegression(family="multinomial", maxIter=1000, tol=1e-9, regParam=1.0 / max(n_train, 1),
                              elasticNetParam=0.0, standardization=False).fit(_assemble(train))


def importances(rf_model, spark, cols=FEATURES) -> DataFrame:
    vals = rf_model.featureImportances.toArray().tolist()
    rows = [(c, float(v)) for c, v in zip(cols, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").select(
        "feature", half_up("importance", 4).alias("importance"))


def _matrix(batch, cols) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1).astype(float)


def spread_seeds(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k start centres from a bounded sample: each next one drawn with probability by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    centres = [points[rng.integers(len(points))]]
    near = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = near.sum()
        at = rng.choice(len(points), p=near / total) if total > 0 else rng.integers(len(points))
        centres.append(points[at])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


class Centres:
    """Centres of one model; labels go to the nearest, the lower index on ties."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = ((x[:, None, :] - self.centres[None, :, :]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at]


CHUNK_ROWS = 2048       # rows whose distances to all centres are held at once


def _assign(x: np.ndarray, stacks: dict):
    """Per number of clusters: the nearest centre (the lower index on ties) of each row of ``x`` for every model of that size.

    ``stacks`` holds centres as (models, clusters, columns); models of one size go through
    the same matrix product.
    """
    for k, c in stacks.items():
        d = ((-2 * c).reshape(-1, c.shape[2]) @ x.T).reshape(len(c), k, len(x))
        d += (c ** 2).sum(axis=2)[:, :, None]
        best, at = d[:, 0], np.zeros((len(c), len(x)), np.int16)
        for j in range(1, k):
            nearer = d[:, j] < best
            np.copyto(best, d[:, j], where=nearer)
            np.copyto(at, np.int16(j), where=nearer)
        yield k, at


def _pass(z: DataFrame, stacks: dict, cols, measure, width: int) -> dict:
    """One pass over the rows: clusters -> (models, clusters, width) sums of what ``measure`` gives for chunks of rows.

    A task sends its sums as one row; they are added in the order of the
    tasks, so reruns agree. What is collected is bounded by the centres and the number of tasks.
    """
    shared = z.sparkSession.sparkContext.broadcast(stacks)

    def run(batches):
        total = {k: np.zeros((len(c), k, width)) for k, c in shared.value.items()}
        for b in batches:
            whole = _matrix(b, cols)
            for low in range(0, len(whole), CHUNK_ROWS):
                x = whole[low:low + CHUNK_ROWS]
                for k, at in _assign(x, shared.value):
                    total[k] += measure(x, at, shared.value[k])
        yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), **{
            f"k{k}": pa.array([t.tobytes()], pa.binary()) for k, t in total.items()}})

    got = z.select(*cols).mapInArrow(run, ", ".join(["task int", *[f"k{k} binary" for k in stacks]])).collect()
    shared.unpersist()
    sums = {k: np.zeros((len(c), k, width)) for k, c in stacks.items()}
    for r in sorted(got, key=lambda r: r.task):
        for k in sums:
            sums[k] += np.frombuffer(r[f"k{k}"]).reshape(sums[k].shape)
    return sums


def _moments(x, at, c):
    """Number and sums of the rows that each model's cluster owns."""
    own = (at[:, None, :] == np.arange(c.shape[1], dtype=at.dtype)[:, None]).reshape(-1, len(x)).astype(float)
    return (own @ np.column_stack([np.ones(len(x)), x])).reshape(*c.shape[:2], -1)


def _costs(x, at, c):
    """Squared distance of the rows that each model's cluster owns, taken from the differences."""
    return np.array([np.bincount(a, ((x - m[a]) ** 2).sum(axis=1), len(m)) for a, m in zip(at, c)])[:, :, None]


def _stacked(centres: dict, names: list) -> tuple[dict, dict]:
    sizes: dict = {}
    for m in names:
        sizes.setdefault(len(centres[m]), []).append(m)
    return sizes, {k: np.stack([centres[m] for m in ms]) for k, ms in sizes.items()}


def lloyd(z: DataFrame, models: dict, cols=FEATURES, most: int = 300) -> dict:
    """model -> (inertia, centres): Lloyd's iterations of all ``models`` (name -> start centres) at once.

    One pass over the rows per iteration moves every model that still
    moves, one stage without a shuffle; a last pass takes the inertia. Centres are rounded to 1e-9 before
    they are compared, so that the order of adding does not matter.
    """
    centres = {m: np.array(c, float) for m, c in models.items()}
    moving = sorted(centres)
    given = dict(centres)
    for _ in range(most):
        sizes, stacks = _stacked(centres, moving)
        sums = _pass(z, stacks, cols, _moments, 1 + len(cols))
        still = []
        for k, ms in sizes.items():
            for i, m in enumerate(ms):
                n, total = sums[k][i, :, :1], sums[k][i, :, 1:]
                new = np.where(n > 0, np.round(total / np.maximum(n, 1), 9), centres[m])
                given[m] = centres[m]           # the inertia is that of the labels, which belong to the centres before the move
                if not np.array_equal(new, centres[m]):
                    centres[m] = new
                    still.append(m)
        moving = sorted(still)
        if not moving:
            break
    sizes, stacks = _stacked(given, sorted(given))
    costs = _pass(z, stacks, cols, _costs, 1)
    inertia = {m: float(costs[k][i].sum()) for k, ms in sizes.items() for i, m in enumerate(ms)}
    return {m: (inertia[m], centres[m]) for m in centres}


TASK_ROWS = 8192        # rows per task of a pass: the passes are many, so tasks follow the rows and not the partitions before
SEED_ROWS = 4000        # rows of the bounded sample that start centres are drawn from


def kmeans_models(features: DataFrame, ks=range(2, 11), restarts: int = 10, seed: int = 42) -> dict:
    """k -> (inertia, silhouette, centres): the best of ``restarts`` seeds per k.

    All (k, seed) models advance together (``lloyd``). The silhouette is
    Spark's squared Euclidean one, which is linear in the rows; see
    ``euclidean_silhouette`` for the other.
    """
    # tasks follow the rows, up to one per core: every pass is one wave of tasks, each sends its sums to the driver
    tasks = max(1, min(-(-features.count() // TASK_ROWS), features.sparkSession.sparkContext.defaultParallelism))
    z = _cut(standardize(features.select("customer_id", *FEATURES)).coalesce(tasks))
    rows = z.orderBy(F.xxhash64(F.lit(seed), "customer_id"), "customer_id").select(*FEATURES).limit(SEED_ROWS).collect()
    sample = np.array([list(r) for r in rows], float)
    if not len(sample):
        return {}
    fits = lloyd(z, {(int(k), r): spread_seeds(sample, int(k), seed + 1000 * int(k) + r) for k in ks for r in range(restarts)})
    best: dict = {}
    for (k, r), (cost, c) in sorted(fits.items()):          # ties: the lower seed index
        if k not in best or cost < best[k][0]:
            best[k] = (cost, c)
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    vectors = _cut(_assemble(with_labels(z, {f"c{k}": c for k, (_, c) in best.items()})))

    def silhouette(k: int) -> float:
        labelled = vectors.select("features", F.col(f"c{k}").cast("double").alias("prediction"))
        return float(ev.evaluate(labelled)) if labelled.select("prediction").distinct().limit(2).count() > 1 else 0.0

    # many short jobs per k: the ks are measured side by side
    measured = dict(zip(sorted(best), side_by_side(z.sparkSession, *[functools.partial(silhouette, k) for k in sorted(best)])))
    return {k: (cost, measured[k], c) for k, (cost, c) in sorted(best.items())}


def with_labels(z: DataFrame, models: dict, cols=FEATURES) -> DataFrame:
    """``z`` with the nearest centre of each model as an int column."""
    shared = z.sparkSession.sparkContext.broadcast(models)
    schema = StructType([*z.schema.fields, *[StructField(m, IntegerType()) for m in models]])

    def run(batches):
        for b in batches:
            x = _matrix(b, cols)
            more = [pa.array(Centres(c).nearest(x)[0].astype(np.int32)) for c in shared.value.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *shared.value])

    return z.mapInArrow(run, schema)


def kmeans_sweep(features: DataFrame, models: dict | None = None) -> DataFrame:
    """k, inertia and silhouette of the sweep (run here unless ``models`` is given)."""
    models = kmeans_models(features) if models is None else models
    rows = pa.table({"k": pa.array(models, pa.int32()), "inertia": pa.array([m[0] for m in models.values()], pa.float64()),
                     "silhouette": pa.array([m[1] for m in models.values()], pa.float64())})
    return features.sparkSession.createDataFrame(rows).select(
        "k", half_up("inertia", 2).alias("inertia"), half_up("silhouette", 4).alias("silhouette"))


def best_k(sweep: DataFrame) -> DataFrame:
    """k with the highest silhouette, the smallest k on ties."""
    return sweep.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("best_k"),
                     F.max("silhouette").alias("best_silhouette"))


def kmeans_labels(features: DataFrame, models: dict | None = None) -> DataFrame:
    """customer_id, segment, cluster by the sweep's own best model: the k with the
    highest silhouette (the smallest on ties) and its best restart."""
    features = _cut(features.select("customer_id", "segment", *FEATURES))
    models = kmeans_models(features) if models is None else models
    k = max(models, key=lambda k: (round(models[k][1], 4), -k))
    return with_labels(standardize(features), {"cluster": models[k][2]}).select("customer_id", "segment", "cluster")


BLOCK_ROWS = 4096       # rows packed into one array
SIDE_ROWS = 524_288     # rows of a group of blocks: a task holds two groups
NEAR = 1e-9             # squared distances below this share of the squared lengths are taken again from the differences


def _pack(cols):
    """Rows (``_own`` and ``cols``) as blocks of at most ``BLOCK_ROWS``, sorted by label: one row of arrays each."""
    most = BLOCK_ROWS

    def pack(t: pa.Table, i: int):
        names, own = np.unique(t.column("_own").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        order = np.argsort(own, kind="stable")
        x = _matrix(t.combine_chunks(), cols)[order]
        return pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "i": pa.array([i], pa.int32()), "n": pa.array([len(x)], pa.int32()),
            "names": pa.array([names.tolist()], pa.list_(pa.string())), "own": pa.array([own[order].astype(np.int32).tobytes()], pa.binary()),
            "x": pa.array([x.tobytes()], pa.binary())})

    def run(batches):
        held, i = None, 0
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= most:
                yield pack(held.slice(0, most), i)
                held, i = held.slice(most), i + 1
        if held is not None and held.num_rows:
            yield pack(held, i)

    return run


def _distance_sums(p, q, to_p, to_q) -> None:
    """Adds the distances between blocks ``p`` and ``q``, each pair once, to the sums of p's rows by q's labels and
    (unless ``to_q`` is None) of q's rows by p's labels.

    A block is (points, label of each row), sorted by label. Squares come from one matrix product;
    where it cancels, from the differences.
    """
    (x, of_x), (y, of_y) = p, q
    lx, ly = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left, right = np.column_stack([-2 * x, lx, np.ones(len(x))]), np.column_stack([y, np.ones(len(y)), ly]).T.copy()
    for low in range(0, len(x), 128):
        for at in range(0, len(y), 512):        # squares that fit the cache
            d = left[low:low + 128] @ right[:, at:at + 512]
            wide = d.shape[1]
            near = np.flatnonzero(d < NEAR * (lx[low:low + 128].max() + ly[at:at + 512].max()))
            if len(near):
                gap = x[low + near // wide] - y[at + near % wide]
                d.reshape(-1)[near] = (gap * gap).sum(axis=1)
            np.sqrt(d, out=d)
            cuts = np.flatnonzero(np.diff(of_y[at:at + 512], prepend=-1))
            to_p[low:low + 128, of_y[at + cuts]] += np.add.reduceat(d, cuts, axis=1)
            if to_q is not None:
                cuts = np.flatnonzero(np.diff(of_x[low:low + 128], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(d)]):
                    to_q[at:at + 512, of_x[low + a]] += d[a:b].sum(axis=0)


def euclidean_silhouette(points: DataFrame, label: str, cols=FEATURES) -> DataFrame:
    """n, n_clusters and the mean Euclidean silhouette of given labels.

    Rows are packed into blocks of ``BLOCK_ROWS``, blocks are dealt into groups, and every pair of
    groups is one task's work: it gives the sums of distances of each row to each cluster of the other
    group, no pair of rows. A row is shuffled once per group, and there are as many groups as give the cores work or as
    memory asks for. The cost is the square of the rows (15,000 rows: 1e8 distances, each pair taken once),
    as the measure asks; rows without a label take no part, a row alone in
    its cluster has 0.
    """
    rows = points.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_own"), *[F.col(c).cast("double").alias(c) for c in cols])
    rows = _cut(rows)
    n, n_labels = rows.agg(F.count(F.lit(1)), F.countDistinct("_own")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = _cut(rows.coalesce(max(1, min(-(-n // BLOCK_ROWS), cores))).mapInArrow(
        _pack(cols), "part int, i int, n int, names array<string>, own binary, x binary"))
    before, total = {}, 0       # blocks are numbered across the tasks that packed them
    for part, number in sorted(map(tuple, blocks.groupBy("part").agg(F.count(F.lit(1))).collect())):
        before[part], total = total, total + number
    side = max(BLOCK_ROWS, min(SIDE_ROWS, 2 ** 23 // max(n_labels, 1)))     # a task keeps a sum per row and label
    groups = max(1, min(total, max(-(-n // side), int(np.ceil(np.sqrt(8 * cores))))))
    offsets = F.array(*[F.lit(before.get(k, 0)) for k in range(max(before, default=0) + 1)])
    numbered = blocks.withColumn("block", F.get(offsets, F.col("part")) + F.col("i")).withColumn("group", F.col("block") % groups)
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other")
    pair = (F.least("group", "other") * groups + F.greatest("group", "other")).alias("pair")
    dealt = numbered.select("*", other).select(pair, "group", "block", "names", "own", "x").repartitionByRange(groups * (groups + 1) // 2, "pair")

    def tile(t):
        names = sorted({v for r in t.column("names").to_pylist() for v in r})
        index = {v: k for k, v in enumerate(names)}
        taken = []
        for group, block, local, own, x in zip(*[t.column(c).to_pylist() for c in ("group", "block", "names", "own", "x")]):
            of = np.array([index[v] for v in local], np.int32)[np.frombuffer(own, np.int32)]
            x = np.frombuffer(x).reshape(len(of), -1)
            taken.append((group, block, (x, of), np.zeros((len(x), len(names)))))
        taken.sort(key=lambda r: r[:2])
        sizes = {g: sum(np.bincount(r[2][1], minlength=len(names)) for r in taken if r[0] == g) for g in {r[0] for r in taken}}
        one = len(sizes) == 1
        for k, (g, _, p, to_p) in enumerate(taken):
            for h, _, q, to_q in taken[k:]:
                if one or g != h:
                    _distance_sums(p, q, to_p, None if p is q else to_q)
        far = {g: sizes[g if one else next(h for h in sizes if h != g)] for g in sizes}
        return pa.table({
            "block": pa.array([r[1] for r in taken], pa.int64()), "names": pa.array([names] * len(taken), pa.list_(pa.string())),
            "own": pa.array([r[2][1].tobytes() if one else None for r in taken], pa.binary()),
            "sizes": pa.array([far[r[0]].tolist() for r in taken], pa.list_(pa.int64())), "sums": pa.array([r[3].tobytes() for r in taken], pa.binary())})

    def measure(t):
        names = sorted({v for r in t.column("names").to_pylist() for v in r})
        index = {v: k for k, v in enumerate(names)}
        total, sizes, own = None, np.zeros(len(names)), None
        for local, mine, n, sums in zip(*[t.column(c).to_pylist() for c in ("names", "own", "sizes", "sums")]):
            at = np.array([index[v] for v in local])
            sums = np.frombuffer(sums).reshape(-1, len(at))
            total = np.zeros((len(sums), len(names))) if total is None else total
            total[:, at] += sums
            sizes[at] += n
            own = own if mine is None else at[np.frombuffer(mine, np.int32)]
        each = np.arange(len(own))
        with np.errstate(all="ignore"):
            a = total[each, own] / (sizes[own] - 1)
            total /= sizes
            total[each, own] = np.nan
            b = np.fmin.reduce(total, axis=1)
            top = np.maximum(a, b)
            s = np.where((sizes[own] == 1) | (len(names) == 1) | (top == 0), 0.0, (b - a) / top)
        return pa.table({"n": pa.array([len(s)], pa.int64()), "s": pa.array([float(s.sum())], pa.float64())})

    sums = dealt.groupBy("pair").applyInArrow(tile, "block bigint, names array<string>, own binary, sizes array<bigint>, sums binary")
    per = sums.groupBy("block").applyInArrow(measure, "n bigint, s double")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"), F.try_divide(F.sum("s"), F.sum("n")).alias("s")).select(
        "n", F.lit(n_labels).cast("bigint").alias("n_clusters"), half_up("s", 4).alias("silhouette"))


def jacobi_eigenpairs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    Sign rule: the entry of largest absolute value of a vector is positive,
    the first of them on ties.
    """
    a, v = m.astype(float).copy(), np.eye(len(m))
    for _ in range(100):
        off = np.sqrt((np.triu(a, 1) ** 2).sum())
        if off <= 1e-15 * max(np.abs(np.diag(a)).max(), 1e-300):
            break
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if a[p, q] == 0.0:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.sqrt(theta * theta + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.eye(len(a))
                turn[p, p] = turn[q, q] = c
                turn[p, q], turn[q, p] = t * c, -t * c
                a = turn.T @ a @ turn
                v = v @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    values, vectors = np.diag(a)[order], v[:, order]
    for k in range(len(values)):
        if vectors[np.abs(vectors[:, k]).argmax(), k] < 0:
            vectors[:, k] = -vectors[:, k]
    return values, vectors


def covariance(z: DataFrame, cols=FEATURES) -> np.ndarray:
    """Population covariance of the columns: one aggregate, a matrix of the columns' number squared on the driver."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = z.agg(*[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v or 0.0
    return out


def pca_2d(features: DataFrame) -> tuple[DataFrame, list]:
    """customer_id, segment, x, y on the first two principal components of the z-scores, and their shares of the variance."""
    z = _cut(standardize(features.select("customer_id", "segment", *FEATURES)))
    values, vectors = jacobi_eigenpairs(covariance(z))

    def dot(k: int):
        return functools.reduce(lambda s, t: s + t, [F.col(c) * F.lit(float(vectors[i, k])) for i, c in enumerate(FEATURES)])

    total = values.sum()
    return z.select("customer_id", "segment", half_up(dot(0), 4).alias("x"), half_up(dot(1), 4).alias("y")), [
        float(values[k] / total) if total > 0 else 0.0 for k in range(2)]
