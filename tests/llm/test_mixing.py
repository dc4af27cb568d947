import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import mixing as M


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, text string, source string, size int, taken string")


def corpus(seed, n, sources):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.randrange(0, 40))) + rng.choice(["", "\n", "  x"]), rng.choice(sources)) for i in range(n)]


def test_targets_and_taken(spark):
    rows = corpus(1, 3000, ["b", "a", "Z", "é", None, "rare"]) + [(9000, None, "a"), (9001, "", "b"), (9001, "", "b"), (None, "k k", "a")]
    rows += [(9002, "one two", "tiny")]
    got = M.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = M.capped_targets(size, {s: 1 + i % 3 for i, s in enumerate(names)})
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    again = M.mix_sources(frame(spark, list(reversed(rows)))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    taken = {}
    by_id = {r[0]: r for r in rows}
    for r in got:
        assert r["size"] == len((by_id[r.doc_id][1] or "").split())
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
    joined = M.mix_sources(frame(spark, rows), keep=("source",)).groupBy("source").agg(
        F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s")).collect()
    for r in joined:
        assert r.s == size[r.source] and abs(r.g - target[r.source]) < 1e-6
        assert abs(r.t - r.g) <= 45


def test_capped_targets_reshare():
    t = M.capped_targets({"a": 1, "b": 100, "c": 100}, {"a": 50, "b": 1, "c": 2})
    assert t["a"] == 3 and abs(t["b"] - 66) < 1e-9 and abs(t["c"] - 132) < 1e-9


def cost(flow_by_pattern, capacity):
    return sum(max(0, f - k * capacity[p]) for p, f in flow_by_pattern.items() for k in (1, 2))


@pytest.mark.parametrize("seed", range(6))
def test_route_is_cheapest(seed):
    rng = random.Random(seed)
    sources = "abc"
    patterns = [p for n in (1, 2, 3) for p in itertools.combinations(sources, n)]
    capacity = {p: rng.randrange(1, 4) for p in rng.sample(patterns, 4)}
    quota = {s: rng.randrange(0, 5) for s in sources}
    flow = M.route(capacity, quota)
    sent = {s: sum(v for (p, t), v in flow.items() if t == s) for s in sources}
    total = {p: sum(v for (q, _), v in flow.items() if q == p) for p in capacity}
    assert all(total[p] <= 3 * capacity[p] for p in capacity) and all(sent[s] <= quota[s] for s in sources)
    best = None
    choices = [[(p, s, v) for v in range(0, quota[s] + 1)] for p in capacity for s in p]
    if any(len(c) > 5 for c in choices) or len(choices) > 8:
        return
    for pick in itertools.product(*choices):
        got, use = dict.fromkeys(sources, 0), dict.fromkeys(capacity, 0)
        for p, s, v in pick:
            got[s] += v
            use[p] += v
        if all(use[p] <= 3 * capacity[p] for p in use) and all(got[s] <= quota[s] for s in got):
            key = (-sum(got.values()), cost(use, capacity))
            best = key if best is None else min(best, key)
    assert (-sum(sent.values()), cost(total, capacity)) == best


def test_overlapping_sources(spark):
    rows = [(i, "a b c d", "s") for i in range(300)]
    member = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("y")))
    got = M.mix_sources(frame(spark, rows), sources=member, weights={"x": 3, "y": 1}).collect()
    assert abs(sum(r.taken for r in got) - 1600) <= 12 and all(r.taken <= 12 for r in got)


def test_empty(spark):
    assert M.mix_sources(frame(spark, [])).collect() == []
    assert [r.taken for r in M.mix_sources(frame(spark, [(1, None, None)])).collect()] == [0]
