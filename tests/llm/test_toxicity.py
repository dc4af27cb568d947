import itertools
import random

import numpy as np
import pyarrow as pa

from ledgerscope.llm import toxicity as T


def brute_marginals(field, u):
    k = {(0, 0): 0.0, (0, 1): field.trans[0], (1, 0): field.trans[1], (1, 1): field.trans[2]}
    total, toxic = 0.0, np.zeros(len(u))
    for y in itertools.product((0, 1), repeat=len(u)):
        w = np.exp(sum(u[i] for i in range(len(u)) if y[i]) + sum(k[a, b] for a, b in zip((0, *y), y)))
        total += w
        toxic += w * np.array(y)
    return toxic / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    field = T.Field()
    field.trans = np.array([-0.7, 0.4, 1.1])
    lengths = np.array([1, 5, 2, 9, 3])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    u = rng.normal(size=lengths.sum())
    odds = field.marginals(u, starts, lengths)
    for s, n in zip(starts, lengths):
        np.testing.assert_allclose(odds[s:s + n] / (1 + odds[s:s + n]), brute_marginals(field, u[s:s + n]), rtol=1e-6)


def corpus(seed, n, bad=("grolk", "snarfen", "snarfig")):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(3, 60))]
        y = int(i % 5 == 0)
        if y:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad).capitalize() + rng.choice(["", ",", "!"]))
        out.append((" ".join(w), y))
    return out


def test_held_out_accuracy_and_spans():
    field = T.fit(corpus(1, 600))
    rows = corpus(1, 900)[600:] + [("x Snarfoz y", 1)]  # a form never seen
    scored = list(T.score_rows(pa.array([t for t, _ in rows]), field))
    right = sum((s >= 0.3) == bool(y) for (s, _), (_, y) in zip(scored, rows))
    assert right >= 0.97 * len(rows)
    for (s, spans), (t, y) in zip(scored, rows):
        if y and s > 0.9:
            assert any(t[x["start"]:x["stop"]].lower().startswith(("grolk", "snarf")) for x in spans)


def test_scores_do_not_depend_on_neighbouring_rows():
    field = T.fit(corpus(2, 300))
    texts = [t for t, _ in corpus(3, 40)] + ["", None, "...", "word " * 30_000]
    whole = [s for s, _ in T.score_rows(pa.array(texts), field)]
    alone = [next(iter(T.score_rows(pa.array([t], pa.string()), field)))[0] for t in texts]
    np.testing.assert_allclose(whole, alone, rtol=1e-9)


def test_query_edges(spark, docs_of):
    docs = docs_of([(i, t) for i, (t, _) in enumerate(corpus(4, 200))] + [(500, None), (501, ""), (None, "grolk"), (3, "a b")])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(corpus(4, 200))] + [(None, 1, 1), (500, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    out = T.score_toxicity(docs, T.learn_toxicity(docs, labels)).collect()
    assert len(out) == 204 and all(0 <= r.score <= 1 for r in out)
    none = T.score_toxicity(docs, T.learn_toxicity(docs, labels.where("toxic = 0"))).collect()
    assert {r.score for r in none} == {0.0}
    assert T.score_toxicity(docs.limit(0), T.fit([])).collect() == []
