import random
from collections import Counter

import numpy as np

from ledgerscope.llm import substring as S


def brute(docs, size):
    words = [(t or "").split() for _, t in docs]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def run(docs_of, docs, size, anchor):
    rows = S.remove_repeats(docs_of(docs), size, anchor).collect()
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows], key=repr)


def random_docs(seed, n, vocab, lengths, passages):
    rng = random.Random(seed)
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [text(k) for k in passages]
    docs = []
    for i in range(n):
        w = text(rng.choice(lengths))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            cut = rng.randrange(len(p))
            part = rng.choice([p, p[cut:], p[:cut]])
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, "  ".join(w)))
    return docs


def test_matches_brute_force(docs_of):
    vocab = [f"w{i}" for i in range(500)]
    docs = random_docs(3, 80, vocab, [0, 5, 35, 60, 200], [36, 50, 90, 120])
    docs += [(200, docs[5][1]), (201, docs[5][1]), (201, docs[5][1]), (None, docs[7][1]), (300, None), (301, ""), (302, " \n\t")]
    assert run(docs_of, docs, 35, 12) == brute(docs, 35)


def test_small_alphabet_and_loops(docs_of):
    docs = random_docs(4, 60, ["a", "b", "É"], [0, 3, 10, 40], [8, 12])
    docs += [(90, "x " * 500), (91, "y " * 9), (92, "p q " * 40)]
    assert run(docs_of, docs, 8, 3) == brute(docs, 8)


def test_long_text(docs_of):
    rng = random.Random(9)
    w = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    docs = [(1, " ".join(w)), (2, " ".join(w[30_000:30_100])), (3, "short one")]
    assert run(docs_of, docs, 35, 12) == brute(docs, 35)


def test_empty_table(docs_of):
    assert run(docs_of, [], 35, 12) == []


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 100, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 24):
        assert (S.sliding_min(x, width) == [x[i:i + width].min() for i in range(50 - width + 1)]).all()


def test_many_copies_of_one_row(docs_of):
    """The spans of a repeated row are listed once, not once per copy."""
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(120))
    frame = docs_of([(7, text)]).crossJoin(docs_of([(0, "")]).sparkSession.range(10_000).select("id")).drop("id")
    out = S.remove_repeats(frame.union(docs_of([(8, "a short one")])))
    rows = out.groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()
    assert sorted(tuple(r) for r in rows) == [(7, 120, 120, "", 10_000), (8, 3, 0, "a short one", 1)]
    spans = S.find_repeats(frame.selectExpr("xxhash64(doc_id, text) AS key", "text"), 35, 12).distinct()
    assert spans.count() <= 120
