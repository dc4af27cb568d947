import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerscope.llm import collocations as C


def brute(docs, least=30, cover=80, top=2000, longest=4):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows = {}
    for (lang, p), a in cand.items():
        longer = [b for (g, q), b in cand.items() if g == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= cover * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, found in rows.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, g, 7, "x", 1.0) for i, (g, t) in enumerate(docs)],
                                 "doc_id bigint, text string, lang string, rank int, phrase string, score double")


def run(spark, docs, **more):
    return sorted(tuple(r) for r in C.collocations(frame(spark, docs).repartition(3), **more).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def sample(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "the", "of", "état", "is", "b", "cc", "東京", "x-y"]
    phrases = ["new york city hall", "state of the art", "A B", "東京 tower"]
    docs = []
    for _ in range(n):
        w = [rng.choice(words + phrases) for _ in range(rng.randrange(40))]
        docs.append((rng.choice(["en", "de", None, "und"]), "".join(x + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  ", "\xa0"]) for x in w)))
    return docs


def test_matches_brute_force(spark):
    docs = sample(1, 300) + [("en", None), ("en", ""), (None, " \t.,"), ("xx", "one " * 500), ("yy", "lo li " * 100)]
    assert run(spark, docs, least=12) == brute(docs, least=12)


def test_ties_and_top(spark):
    docs = [("en", f"a{k % 7} b{k % 7}. c d") for k in range(300)]
    assert run(spark, docs, top=4) == brute(docs, top=4)
    assert run(spark, docs) == brute(docs)


def test_repeated_rows_and_shared_limits(spark, monkeypatch):
    """Vocabulary in several blocks, tiny buffers, wide keys: the same rows."""
    docs = sample(2, 120) + [("en", "alpha beta gamma delta. " * 3)] * 40
    want = brute(docs, least=10)
    assert run(spark, docs, least=10) == want
    monkeypatch.setattr(C, "VOCABULARY_BLOCK", 3)
    monkeypatch.setattr(C, "KEYS_HELD", 5)
    monkeypatch.setattr(C, "RAW_KEYS", 4)
    monkeypatch.setattr(C, "SLICE_BYTES", 200)
    monkeypatch.setattr(C, "SHARD_KEYS", 64)
    monkeypatch.setattr(C, "BITMAP_BITS", 6)
    assert run(spark, docs, least=10) == want


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("en", "too rare")]) == []


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
@pytest.mark.parametrize("shard_bits", [0, 3])
def test_filters_give_back_every_key(bits, shard_bits):
    rng = np.random.default_rng(bits)
    half = 2 * bits
    left, right = (rng.integers(0, 1 << half, 3000, dtype=np.uint64) for _ in range(2))
    a, b = C.permute(left, right, half)
    assert (np.stack(C.restore(a, b, half)) == np.stack([left, right])).all()
    hi, lo = C.aligned(a, b, half)
    assert (np.stack(C.halves(hi, lo, half)) == np.stack([a, b])).all()
    n = rng.integers(1, 10 ** 6, 3000) >> rng.integers(0, 20, 3000)
    n = np.maximum(n, 1)
    hi, lo, n = C.summed(hi, lo, n)
    shard = hi >> np.uint64(64 - shard_bits) if shard_bits else np.zeros(len(hi), np.uint64)
    for s in np.unique(shard):
        at = shard == s
        part = C.pack_filter(hi[at], None if lo is None else lo[at], n[at], shard_bits, half)
        back = C.unpack_filter(part, int(s), shard_bits, half)
        assert (back[0] == hi[at]).all() and (back[2] == n[at]).all() and (lo is None or (back[1] == lo[at]).all())


def test_scores_beyond_64_bits(spark):
    """The score's product is exact where it passes 64 bits."""
    row = spark.range(1).selectExpr("CAST(9007199254740993 AS BIGINT) AS a", "CAST(9007199254740995 AS BIGINT) AS l", "CAST(9007199254740997 AS BIGINT) AS r")
    from pyspark.sql import functions as F
    expr = f"CAST(CAST({C.SCALE} AS DECIMAL(20,0)) * CAST(a AS DECIMAL(18,0)) DIV CAST(l + r AS DECIMAL(20,0)) AS BIGINT)"
    assert row.select(F.expr(expr)).first()[0] == 2_000_000 * 9007199254740993 // (9007199254740995 + 9007199254740997)


def test_word_hash_has_no_structural_collisions():
    """The two Thue-Morse words of 1,024 letters, which any polynomial modulo 2**64 takes for one."""
    from ledgerscope.llm.textarrays import WordHasher, chained_hash, white_space_separators
    t = "a"
    for _ in range(10):
        t += t.translate(str.maketrans("ab", "ba"))
    words = [t, t.translate(str.maketrans("ab", "ba")), t[:200], t[:200].translate(str.maketrans("ab", "ba")), "a", "b", "ab", "ba"]
    text = " ".join(words).encode()
    h, _, start, end = WordHasher(white_space_separators()).words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(set(h.tolist())) == len(words)
    other = ("xx" + " ".join(words[::-1])).encode()
    data = np.frombuffer(other, np.uint8)
    spans = [(other.index(b" " + w.encode() + b" ") + 1, len(w)) for w in words[1:-1]]
    again = chained_hash(data, np.array([s for s, _ in spans]), np.array([s + n for s, n in spans]), np.uint64(0))
    assert again.tolist() == h[1:-1].tolist()
