import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import pii as P


def brute(text):
    """The contract's patterns, word for word."""
    out = []
    for kind, pattern in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(c) for c in digits[::-1][0::2]]
            even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
            ok = (True, kind == 1 and all(int(p) < 256 for p in m[0].split(".")), 13 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0,
                  9 <= len(digits) <= 15)[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(4)
    words = ["the", "Haus", "erable", "tion,", "of.", "ñandú", "are", "in"]
    contexts = [(" ".join(rng.choice(words) for _ in range(14)), []) for _ in range(200)]
    t = P.Tagger()
    t.train(P.training_windows(contexts))
    return t


CASES = ["", None, "a@b.c@d.e @b.c x.y+z@host-1.example.com.", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
         "+1 (743) 555-3824 or +12 or +123456789012345678 +1 2 3", "é" * 10 + " 10.0.0.1é", "0" * 5000, "a." * 2000 + "@", "@" * 50, "1." * 3000, "+1" + " " * 50 + "2",
         "4111111111111111 4111111111111111", "x 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 y"]


def test_patterns_match_the_contract():
    rng = random.Random(1)
    bits = ["a", "B7", "@", ".", "-", " ", "+", "12", "255", "(", ")", "4111111111111111", "%", "\n", "é", "x.org", "1.2.3.4"]
    for text in CASES + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]:
        assert sorted((k, s, e) for k, s, e, ok in P.shapes(text or "") if ok) == brute(text), text


def test_gradient_matches_differences():
    tagger = P.Tagger(hidden=3, dtype=np.float64)
    rng = np.random.default_rng(0)
    x = rng.integers(1, P.N_CLASSES, (3, 7))
    y = np.stack([P.labels_of(7, [(0, 1, 4)]), P.labels_of(7, [(2, 0, 2), (2, 2, 5)]), P.labels_of(7, [])])
    lengths = np.array([7, 5, 6])
    for k in tagger.p:
        tagger.p[k] = tagger.p[k] + rng.normal(0, 0.3, tagger.p[k].shape)
    loss, grad = tagger.loss_and_gradient(x, y, lengths)
    for name, value in tagger.p.items():
        flat = value.reshape(-1)
        for at in rng.integers(0, len(flat), 6):
            old = flat[at]
            flat[at] = old + 1e-5
            up = tagger.loss_and_gradient(x, y, lengths)[0]
            flat[at] = old - 1e-5
            down = tagger.loss_and_gradient(x, y, lengths)[0]
            flat[at] = old
            assert abs((up - down) / 2e-5 - grad[name].reshape(-1)[at]) < 2e-4, name


def test_chain_sums_over_all_paths():
    tagger = P.Tagger(hidden=2, dtype=np.float64)
    rng = np.random.default_rng(3)
    tagger.p["trans"] = rng.normal(0, 1, (P.LABELS, P.LABELS))
    x = rng.integers(1, P.N_CLASSES, (1, 4))
    scores = tagger.emissions(x)[:, 0]
    total, best = -np.inf, (-np.inf, None)
    for path in np.ndindex(*[P.LABELS] * 4):
        s = P.FORBIDDEN[0][path[0]] + sum(scores[t, c] for t, c in enumerate(path)) + sum(
            (tagger.p["trans"] + P.FORBIDDEN)[a, b] for a, b in zip(path, path[1:]))
        total = np.logaddexp(total, s)
        best = max(best, (s, path))
    alpha, beta, log_z, *_ = tagger.chain(tagger.emissions(x), np.array([4]))
    assert abs(log_z[0] - total) < 1e-6
    assert tuple(tagger.decode(x, np.array([4]))[0][0]) == best[1]


def test_network_adds_what_patterns_miss(tagger):
    rng = random.Random(8)

    def valid_card():
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(16))
            if P.luhn(d):
                return d

    found = asked = 0
    for _ in range(60):
        a, b = valid_card(), valid_card()
        phone = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        mail = f"anna{rng.randrange(100)} [at] host{rng.randrange(10)} [dot] com"
        for want, text in ((2, f"the tion {a} {b} erable are in"), (1, f"of the Haus {phone} are, tion"), (1, f"Haus tion the {mail} are of")):
            spans = P.find_spans([text], tagger)[0]
            asked += want
            found += sum(text[s:e] in (a, b, phone, mail) for _, s, e, base in spans if not base)
    assert found >= 0.8 * asked
    clean = ["on 2024-05-17 at 12:30 the v1.2.3 cost 1,234.50 of 100", "token 1eb9c654e721b4f812088970e66a6345cee33dd6 in 1999-2004", "x" * 300, "call @home or a @ 2.50 each"]
    assert all(not spans for spans in P.find_spans(clean, tagger))


def test_windows_cover_regions_and_long_texts(tagger):
    for low, high in ((0, 1), (5, 133), (5, 134), (0, 1000)):
        w = P.windows_of(low, high)
        assert w[0][0] == low and w[-1][1] == high and all(b[0] - a[0] <= P.STRIDE for a, b in zip(w, w[1:]))
    text = " ".join(["7 8 9 1"] * 400) + " (743) 555-3824 tion"
    spans = P.find_spans([text], tagger)[0]
    assert all(0 <= s < e <= len(text) for _, s, e, _ in spans)


class Marker:
    """Stands for a network that is sure of one stretch of characters, wherever it is."""

    def __init__(self, kind, codes):
        self.kind, self.codes = kind, codes

    def decode(self, x, lengths):
        paths, n = np.zeros(x.shape, np.int64), len(self.codes)
        for row, path in zip(x, paths):
            for at in range(len(row) - n + 1):
                if (row[at:at + n] == self.codes).all():
                    path[at], path[at + 1:at + n] = 1 + 2 * self.kind, 2 + 2 * self.kind
        return paths, np.ones(x.shape)


def test_every_position_is_looked_at():
    """Digits far apart and at signs in any case are read too, wherever they stand."""
    for kind, span in ((1, "7 [dot] 8 [dot] 9 [dot] 6"), (0, "anna (At) host.org"), (2, "4  -  111 1111 1111 1111"), (3, "+1\n743\n555\n3824")):
        if not P.plausible(kind, span):
            continue
        for before in (0, 1, 63, 64, 100, 128, 300):
            text = "x" * before + " " + span + " " + "y" * 200
            spans = P.find_spans([text], Marker(kind, P.coded(span)))[0]
            assert (kind, before + 1, before + 1 + len(span), False) in spans, (span, before)


def test_windows_left_undecoded_hold_no_plausible_span():
    rng = random.Random(5)
    bits = ["a", "7", "12", "@", " ", ".", "-", "(", ")", "+", "[at]", "{ AT }", "[dot]", "(.)", "x.org", "\n", "é", "4111111111111111"]
    seen = 0
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        if not P.may_pass(text):
            seen += 1
            assert not any(P.plausible(k, text[s:e]) for k in range(4) for s in range(len(text)) for e in range(s + 1, len(text) + 1)), text
    assert seen > 100


def test_reconcile_is_the_best_set():
    rng = random.Random(2)
    for _ in range(200):
        found = {}
        for _ in range(rng.randrange(7)):
            s = rng.randrange(20)
            found[rng.randrange(4), s, s + rng.randrange(1, 6)] = rng.random()
        base = [(0, s, s + 2) for s in rng.sample(range(20), 2)]
        got = P.reconcile(base, found)
        items = list(found.items())
        best = 0.0
        for mask in range(1 << len(items)):
            chosen = [items[k] for k in range(len(items)) if mask >> k & 1]
            every = [k[1:] for k, _ in chosen]
            if all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(every) for b in every[:i]) and \
                    all(a[1] <= s or e <= a[0] for a in every for _, s, e in base):
                best = max(best, sum(v for _, v in chosen))
        assert abs(sum(found[g] for g in got) - best) < 1e-9


def test_query_columns_and_edge_cases(spark, docs_of, tagger):
    docs = [(i, t) for i, t in enumerate(CASES)] + [(4, CASES[4]), (None, CASES[3])]
    out = P.find_personal_data(docs_of(docs), tagger, keep=("hits",))
    assert out.columns == ["doc_id", "hits", "spans"]
    base = F.filter("spans", lambda s: s["base"])
    rows = out.select("doc_id", P.spelled(base).alias("b"), P.spelled(F.col("spans")).alias("all")).collect()
    want = sorted((d if d is not None else -1, ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in brute(t))) for d, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.b) for r in rows) == want
    assert all(set(r.b.split(",")) <= set(r.all.split(",")) or not r.b for r in rows)
    assert P.find_personal_data(docs_of([]), tagger).count() == 0


def test_sample_and_fit_on_given_rows(spark, docs_of):
    docs = [(i, f"some words here {i % 50}@mail{i % 7}.example.com and tion 10.0.{i % 200}.1 ok") for i in range(400)] + [(900, None), (901, "")] + [(902, "plain text")] * 50
    got = P.sample_windows(docs_of(docs), per_kind=20)
    assert len(got) == len({t for t, _ in got}) and 20 <= len(got) <= 61
    for text, spans in got:
        assert len(text) <= P.TRAIN_LENGTH and [(k, s, e) for k, s, e, ok in sorted(P.shapes(text), key=lambda x: x[1]) if ok] == spans
    assert P.sample_windows(docs_of([])) == []


def test_query_against_brute_force(spark, docs_of, tmp_path):
    docs = [(i, f"call +1 (743) 555-{3000 + i} or {i}@mail{i % 7}.example.com from 10.0.{i % 300}.1 tion") for i in range(60)]
    docs += [(100 + i, t) for i, t in enumerate(CASES)] + [(3, docs[3][1])]
    docs_of(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.pii_query(spark, str(tmp_path)).collect()
    assert rows[0].__fields__ == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for d, t in docs:
        spans = brute(t)
        want.append((d, *[sum(k == j for k, _, _ in spans) for j in range(4)],
                     hashlib.sha256(",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    assert sorted(tuple(r)[:-1] for r in rows) == sorted(want)
