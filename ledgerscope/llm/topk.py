"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to many pivots are precomputed. By the triangle
inequality |d(q,p) - d(x,p)| bounds d(q,x) from below for every pivot p, and
the largest such bound gives an upper bound of the inner product:
(|q|^2 + |x|^2 - d^2) / 2. A task evaluates its candidates in bound order
and stops when no bound left can reach the k-th best score found so far.

Queries are a stated set, broadcast in blocks of ``block`` rows; the
candidates are never shuffled. A task sends on at most k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerscope.llm.store import share

PIVOTS = 48
BLOCK = 4096
EXACT = float(1 << 53)


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """List column to float rows; shorter lists are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(size.max(initial=0)), dims or 0, 1)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def widen(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row to every pivot."""
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = widen(x, width), widen(pivots, width)
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def dot(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; exact also where float sums would round."""
    most = np.abs(rows).max(initial=0) * np.abs(q).max(initial=0) * len(q)
    if most < EXACT:
        return (rows @ q).astype(np.int64)
    a, b = rows.astype(object), q.astype(object)
    to_int = np.frompyfunc(int, 1, 1)
    return np.array((to_int(a) * to_int(b)).sum(axis=1), dtype=np.int64)


class Queries:
    """One block of queries with their pivot distances, and what is best so far."""

    def __init__(self, ids, vectors: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.q, self.pivots, self.k = list(ids), vectors, pivots, k
        self.d = distances(vectors, pivots)
        self.sq = (vectors * vectors).sum(1)

    def scan(self, batches):
        """Best k candidates of each query among the rows of one task."""
        none = np.zeros(0, np.int64)
        best = [(none, none) for _ in self.ids]
        for b in batches:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            x = matrix(b.column("ints"))
            if not len(ids):
                continue
            width = max(x.shape[1], self.q.shape[1])
            x, q = widen(x, width), widen(self.q, width)
            table = np.ascontiguousarray(distances(x, self.pivots).T)
            sq = (x * x).sum(1)
            for i, own in enumerate(self.ids):
                low = np.zeros(len(ids))
                for p in range(len(table)):
                    np.maximum(low, np.abs(table[p] - self.d[i, p]), out=low)
                scale = self.sq[i] + sq
                bound = (scale - low * low) / 2 + 1e-6 * scale + 1e-3
                best[i] = self._evaluate(best[i], ids, x, q[i], bound, own)
        out_q, out_v, out_s = [], [], []
        for own, (score, vec) in zip(self.ids, best):
            out_q += [own] * len(vec)
            out_v += vec.tolist()
            out_s += score.tolist()
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()),
                                          "score": pa.array(out_s, pa.int64())})

    def _evaluate(self, best, ids, x, q, bound, own):
        score, vec = best
        reach = score[-1] if len(score) == self.k else None
        live = np.flatnonzero(bound >= reach) if reach is not None else np.arange(len(ids))
        step = 64
        while len(live):
            if step < len(live):
                part = np.argpartition(-bound[live], step - 1)
                take, live = live[part[:step]], live[part[step:]]
            else:
                take, live = live, live[:0]
            take = take[ids[take] != own]
            score = np.concatenate([score, dot(x[take], q)])
            vec = np.concatenate([vec, ids[take]])
            order = np.lexsort((vec, -score))[:self.k]
            score, vec = score[order], vec[order]
            if len(score) == self.k:
                live = live[bound[live] >= score[-1]]
            step *= 4
        return score, vec


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0,
          pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """The k highest integer inner products of each query with all other rows.

    Components become floor(scale * x). Returns query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id. Defined cases: vectors that
    are null or hold null or non-finite components, and rows without a vec_id,
    take no part; shorter vectors count as filled up with zeros; a query is
    compared with every row of another vec_id, so repeated rows of its own id
    are no candidates and repeated candidates count one by one; repeated query
    rows are answered once, and query rows that share an id but differ are one
    query that ranks the scores of all of them, as the SQL does; fewer than k candidates give fewer rows, no rows
    give none; scores must fit 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(sound)
    ints = usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), is_query.alias("is_query"),
                         F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("ints"))
    picked = ints.orderBy(F.xxhash64("vec_id", "ints"), "vec_id").select("ints").limit(pivots).toArrow()
    answers = None
    if picked.num_rows:
        pivot_rows = matrix(picked.column("ints").combine_chunks())
        queries = ints.where("is_query").select("vec_id", "ints").distinct()
        for ids, rows in query_blocks(queries, block):
            shared = share(spark, Queries(ids, rows, pivot_rows, k))
            found = ints.select("vec_id", "ints").mapInArrow(
                lambda batches, shared=shared: shared().scan(batches),
                "query_id bigint, vec_id bigint, score bigint")
            answers = found if answers is None else answers.unionAll(found)
    if answers is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query_blocks(queries: DataFrame, block: int):
    """The query vectors, at most ``block`` at a time on the driver."""
    ids, rows = [], []
    for r in queries.toLocalIterator():
        ids.append(int(r.vec_id))
        rows.append(r.ints)
        if len(ids) == block:
            yield ids, matrix(pa.array(rows, pa.list_(pa.int64())))
            ids, rows = [], []
    if ids:
        yield ids, matrix(pa.array(rows, pa.list_(pa.int64())))


def topk_query(spark, sf_dir: str) -> DataFrame:
    """op9: rows with vec_id divisible by 100 against all rows."""
    from ledgerscope.sources.tables import read_table
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, vec_id, score,
             CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
