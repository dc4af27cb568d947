import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerscope.llm import quality as Q
from ledgerscope.llm.labelled import fold


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 80))]
        kind = i % 6
        text = " ".join(w) + "." if kind else rng.choice([" | ".join(w), " ".join(x + "%%%" for x in w), " ".join([w[0]] * 40)])
        out.append((i, text, int(kind > 0)))
    return out


def test_context_sums_match_a_loop():
    data = np.frombuffer("Ab c!! d\x0be ñ7".encode(), np.uint8)
    tokens = Q.Tokens()
    h, row = tokens.read(data, np.array([0, 5, len(data)]))
    assert len(h) == 7 and row.tolist() == [0, 0, 0, 1, 1, 1, 1]
    total = np.zeros(Q.BUCKETS * Q.DIMS, np.int64)
    Q.add_contexts(total, h, row)
    slow = np.zeros((Q.BUCKETS, Q.DIMS), np.int64)
    bucket, plus, minus = Q.index_of(h)
    for t in range(len(h)):
        for o in (-2, -1, 1, 2):
            if 0 <= t + o < len(h) and row[t + o] == row[t]:
                turn = int(o < 0)
                slow[bucket[t], (plus[t + o] + turn) % Q.DIMS] += 1
                slow[bucket[t], (minus[t + o] + turn) % Q.DIMS] -= 1
    assert (total.reshape(slow.shape) == slow).all()


def test_pooling_is_per_row():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(Q.BUCKETS, Q.DIMS)).astype(np.float32)
    texts = ["a b c", "", None, "x", "long " * 40_000, "| | %%%"]
    whole = Q.pooled(pa.array(texts), table)
    alone = np.concatenate([Q.pooled(pa.array([t], pa.string()), table) for t in texts])
    np.testing.assert_allclose(whole, alone, rtol=1e-4, atol=1e-6)
    assert (whole[1] == 0).all() and (whole[2] == 0).all()


def test_held_out_accuracy(spark, docs_of):
    rows = corpus(1, 900)
    docs = docs_of([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "a b")])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5000, None, None)], "doc_id bigint, quality int, toxic int")
    out = Q.score_quality(docs, Q.learn_quality(docs, labels)).withColumn("held", fold("doc_id", 5, 0)).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held and r.doc_id in truth]
    assert len(out) == 903 and len(held) > 100
    assert sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in held) >= 0.95 * len(held)


def test_missing_classes(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "c")])
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in Q.score_quality(docs, Q.learn_quality(docs, one)).collect()} <= {1.0, 0.0}
    assert {r.score for r in Q.score_quality(docs, Q.learn_quality(docs, one.limit(0))).collect()} == {0.0}
    assert Q.score_quality(docs.limit(0), Q.learn_quality(docs.limit(0), one)).collect() == []


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = Q.Network(x, y, np.ones(2000))
    assert abs(net.score(x).mean() - y.mean()) < 0.05 and net.temperature == pytest.approx(net.temperature)


def test_sample_takes_each_id_once_and_only_ids_with_a_text(spark, docs_of):
    from pyspark.sql import functions as F
    from ledgerscope.llm.labelled import labelled_sample
    docs = docs_of([(i, f"text of {i}") for i in range(200)] + [(3, "text of 3")] * 60 + [(4, "a text of 4")] * 60 + [(900, None)])
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(5000)] + [(900, 1), (None, 1)], "doc_id bigint, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), {0: 20, 1: 20})
    assert len(got) == len({t for t, _ in got}) == 40 and sum(y for _, y in got) == 20
    every = labelled_sample(docs, labels, "quality", F.lit(True), {0: 500, 1: 500})
    assert sorted((t.removeprefix("a "), y) for t, y in every) == sorted((f"text of {i}", i % 2) for i in range(200))
    few = labelled_sample(docs, labels, "quality", F.lit(True), {0: 500, 1: 500}, most_bytes=100)
    assert 6 <= len(few) <= 11 and {y for _, y in few} == {0, 1}
    assert labelled_sample(docs_of([]), labels, "quality", F.lit(True), {0: 5}) == []
