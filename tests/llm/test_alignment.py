import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerscope.llm import alignment as A


@pytest.fixture(scope="module")
def files():
    return A.Vocabularies.read()


@pytest.fixture(scope="module")
def encoders(files):
    return A.Encoders(files)


def brute(docs, files):
    """Plain loops over byte ranges, with the tokenizers themselves."""
    tok = Tokenizer.from_file(A.BYTE_BPE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
    alphabet = A.byte_alphabet()
    found, pairs = [], Counter()
    for d, t in docs:
        a, b = [], []
        if t:
            raw = (" " + t).encode()
            a = [(k, bytes(alphabet[c] for c in tok.id_to_token(k))) for k in tok.encode(" " + t, add_special_tokens=False).ids]
            b = [(k, bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode())
                 for k, p in ((k, sp.id_to_piece(k)) for k in sp.encode(t))]
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for k, x in side:
                out.append((k, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        common = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, low = [], 0
        for c in common:
            groups.append("|".join(",".join(str(k) for k, s, e in side if low < e <= c) for side in spans))
            low = c
        pairs.update(links)
        found.append((d, len(a), len(b), links, groups))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return sorted((d, n_a, n_b, len(g), len(ls), sum(pairs[p] == most[p[1]] for p in ls), sum(pairs[p] for p in ls),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n_a, n_b, ls, g in found)


def run(docs_of, docs, files, chunk=None, monkeypatch=None):
    rows = A.align_tokens(docs_of(docs).repartition(3), files)
    rows = A.write_table(rows.withColumn("groups_sha256", F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))), "aligned")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = A.with_link_counts(rows, A.link_counts(rows, A.pair_bits(files)), names)
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect())


CASES = ["plain words, and 3 numbers 12345!", "", None, " ", "  two  spaces \n\n\ttabs", "Ünïcödé ñandú 東京 😀👍🏽", "x" * 5000, " " * 5000,
         "a <|endoftext|> b </s> <s> [INST]", "▁ piece mark", "\x00\x01 control", "don't we'll I'M", " nbsp　wide", "<unk>"]


def test_matches_brute_force(docs_of, files):
    rng = random.Random(5)
    vocab = ["erable", "Haus", "tion", "the", "ing,", "éü", "42", "😀", "\n", "$%", "mente"]
    docs = [(i, t) for i, t in enumerate(CASES)]
    docs += [(100 + i, " ".join(rng.choice(vocab) + rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(100, docs[0][1]), (7, docs[0][1])]
    assert run(docs_of, docs, files) == brute(docs, files)


def test_chunks_do_not_change_results(docs_of, files, monkeypatch):
    docs = [(i, f"some words {i} and tion{i % 3} again") for i in range(60)]
    whole = run(docs_of, docs, files)
    assert whole == brute(docs, files)
    taken = A.align_tokens
    monkeypatch.setattr(A, "SLICE_BYTES", 60)
    monkeypatch.setattr(A, "CHUNK_LINKS", 20)
    assert taken is A.align_tokens and run(docs_of, docs, files) == whole


def test_empty_table(docs_of, files):
    assert run(docs_of, [], files) == []


def test_quick_encoding_equals_the_file(encoders):
    """Both ways to encode A agree on every code point, in and between words."""
    texts = []
    for low in range(0, 0x110000, 64):
        points = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        texts.append(" ".join(f"a{c}b {c}{c} 1{c}" for c in points))
    for t in texts:
        assert encoders.quick.encode_ordinary(t) == encoders.whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(20))
def test_walk_finds_all_common_ends(seed):
    rng = np.random.default_rng(seed)
    ends = [np.unique(np.append(rng.integers(1, 400, rng.integers(1, 200)), 400)) for _ in range(2)]
    if seed % 2:
        ends[1] = np.unique(np.append(ends[0], ends[1][:3]))
    a, b = A.walk(ends[0].tolist(), ends[1].tolist())
    common = np.intersect1d(*ends)
    assert (ends[0][a - 1] == common).all() and (ends[1][b - 1] == common).all()


def test_long_runs(encoders):
    for text in (" " * 300_000 + "x", "a" * 200_000, "\n" * 200_000, "ab " * 100_000, "é" * 100_000):
        a, b = A.Aligner(encoders).encode(text)
        assert b"".join(encoders.a_bytes[k] for k in a) == (" " + text).encode() or not a
