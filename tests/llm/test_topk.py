import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import topk as T


def brute(rows, k, is_query, scale=1024):
    ok = [(i, [math.floor(scale * v) for v in e]) for i, e in rows
          if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out = []
    for q in sorted({i for i, _ in ok if is_query(i)}):
        qe = next(e for i, e in ok if i == q)
        s = sorted((-sum(a * b for a, b in zip(qe, e)), i) for i, e in ok if i != q)[:k]
        out += [(q, r, i, -score) for r, (score, i) in enumerate(s, 1)]
    return out


def run(spark, rows, k, **kw):
    frame = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id bigint, embedding array<double>, label int, score int")
    return sorted(tuple(r) for r in T.top_k(frame, F.col("vec_id") % 5 == 0, k, **kw).collect())


def vectors(seed, n, dims, ties):
    rng = random.Random(seed)
    pool = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(max(1, n // ties))]
    return [(i, list(rng.choice(pool))) for i in range(n)]


@pytest.mark.parametrize("n, dims, ties", [(150, 8, 1), (200, 5, 20), (60, 16, 60)])
def test_matches_brute_force(spark, n, dims, ties):
    rows = vectors(n, n, dims, ties)
    assert run(spark, rows, 4) == brute(rows, 4, lambda i: i % 5 == 0)


def test_blocks_of_queries_and_few_candidates(spark):
    rows = vectors(1, 12, 3, 2)
    assert run(spark, rows, 20, block=2, pivots=2) == brute(rows, 20, lambda i: i % 5 == 0)


def test_unsound_vectors_take_no_part(spark):
    rows = vectors(2, 20, 4, 1) + [(100, None), (105, [1.0, None, 0.0, 0.0]), (110, [float("nan")] * 4),
                                   (115, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0] * 4), (120, []), (125, [0.5])]
    assert run(spark, rows, 5) == brute(rows, 5, lambda i: i % 5 == 0)


def test_scores_beyond_float_precision(spark):
    rows = [(0, [70_000.3, -80_000.7]), (1, [91_234.56, 1e5]), (2, [91_234.57, 1e5]), (3, [-3.0, 2e5])]
    assert run(spark, rows, 3) == brute(rows, 3, lambda i: i % 5 == 0)


def test_empty(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [(1, [1.0])], 3) == []


def test_two_vectors_under_one_query_id(spark):
    """Both rows ask; the answer ranks the scores of both, however the rows are dealt."""
    rows = vectors(3, 30, 4, 1) + [(5, [0.9, -0.2, 0.4, 0.1]), (5, [0.9, -0.2, 0.4, 0.1])]
    ints = [(i, [math.floor(1024 * v) for v in e]) for i, e in rows]
    asked = {tuple(e) for i, e in ints if i == 5}
    want = sorted((-sum(a * b for a, b in zip(q, e)), i) for q in asked for i, e in ints if i != 5)[:4]
    for order in (rows, rows[::-1]):
        got = [r for r in run(spark, order, 4) if r[0] == 5]
        assert got == [(5, k, i, -s) for k, (s, i) in enumerate(want, 1)]
