import hashlib
import random

import numpy as np
import pytest

from ledgerscope.llm import chatformat as C

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "\\", "<", "[", "s>", "INST]", "/INST]", "a", "é", "日本", "😀", " ", "\n"]


def test_escape_round_trip():
    rng = random.Random(0)
    for _ in range(2000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        e = C.escape(t)
        assert C.unescape(e) == t
        assert not C.MARK.search(e) and "<|endoftext|>" not in e
        assert C.unescape_role(C.escape_role(t)) == t and "\n" not in C.escape_role(t)


def test_token_mask_by_binary_search():
    rng = np.random.default_rng(1)
    for _ in range(50):
        edges = np.unique(rng.integers(0, 60, 12))
        spans = np.array(list(zip(edges[:-1:2], edges[1::2]))).reshape(-1, 2)
        cuts = np.unique(np.append(rng.integers(0, 60, 20), [0, 60]))
        tokens = np.stack([cuts[:-1], cuts[1:]], axis=1)
        slow = [any(s < b and a < e for s, e in spans) for a, b in tokens]
        assert C.token_mask(tokens, spans).tolist() == slow


def turns_of(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool\nx"]), text()) for c in range(30) for t in range(rng.randrange(1, 7))]
    rows += [(50, 0, "assistant", None), (51, 0, None, "x"), (52, None, "user", "first"), (52, 1, "assistant", "yes"),
             (52, 1, "assistant", "yes"), (None, 0, "assistant", "no id"), (53, 0, "assistant", ""), (54, 0, "assistant", "long " * 60_000)]
    rows += [(55, t, "user" if t % 2 else "assistant", f"turn {t} " * 200) for t in range(300)]
    return rows


def test_round_trip_and_mask(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, piece string")
    got = {r.conv_id: r for r in C.digest_conversations(C.format_conversations(frame)).collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_pieces_encode_like_the_whole(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").where("conv_id = 55")
    parts = sorted(C.format_conversations(frame).collect(), key=lambda r: r.piece)
    assert len(parts) > 1
    tokenizer = C.load_tokenizer(open(C.TOKENIZER, encoding="utf-8").read())
    whole = tokenizer.encode("".join(p.text for p in parts), add_special_tokens=False)
    assert whole.ids == [i for p in parts for i in p.token_ids]
    assert all(len(p.token_ids) == len(p.loss) for p in parts)


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.digest_conversations(C.format_conversations(frame)).collect() == []
