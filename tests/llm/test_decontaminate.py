import hashlib
import random
import re

from ledgerscope.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, n=10):
    wins = {}
    for item, t in bench:
        w = WORD.findall(lower(t))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, items = set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                own = wins.get(tuple(w[i:i + k]))
                if own:
                    hit |= set(range(i, i + k))
                    items |= own
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=repr)


def run(spark, docs_of, docs, bench, **kw):
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    found = D.find_contamination(docs_of(docs), b, **kw)
    rows = found.select("doc_id", "n_words", D.hit_words().alias("n_hit"), "items").collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows], key=repr)


def cases():
    rng = random.Random(1)
    vocab = ["of", "the", "ñandú", "été", "a1", "x", "yy", "zebra"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 14, 30])))) for i in range(8)]
    bench += [(None, "only these four words"), (90, None), (91, ""), (92, "..."), (1, bench[0][1])]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 40, 300]))]
        if i % 3 == 0:
            w[len(w) // 2:len(w) // 2] = bench[i % 8][1].upper().split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (101, "Only, THESE. four words"), (101, "Only, THESE. four words"), (None, docs[3][1])]
    return docs, bench


def test_matches_brute_force(spark, docs_of):
    docs, bench = cases()
    assert run(spark, docs_of, docs, bench) == brute(docs, bench)


def test_benchmark_in_several_blocks(spark, docs_of):
    docs, bench = cases()
    assert run(spark, docs_of, docs, bench, block_words=25) == brute(docs, bench)


def test_long_text_and_long_shift(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(40))
    text = " ".join(f"v{i}" for i in range(30_000)) + " " + item + " tail" * 5000
    docs = [(1, text), (2, "clean text")]
    assert run(spark, docs_of, docs, [(7, item)]) == brute(docs, [(7, item)])


def test_empty_tables(spark, docs_of):
    assert run(spark, docs_of, [], [(1, "a b")]) == []
    assert run(spark, docs_of, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_remove_keeps_columns(spark, docs_of):
    b = spark.createDataFrame([(1, "bad words here")], "item_id bigint, text string")
    docs = docs_of([(1, "some BAD words here now"), (2, "fine"), (3, None)]).selectExpr("*", "'i' AS items", "9 AS n_words", "0 AS __row")
    left = D.remove_contaminated(docs, b)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, docs.where("doc_id > 1").collect()))


def test_digest_of_no_items(spark):
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_block_memory_is_bounded():
    """Half a block of long items takes well under 300 MB while it is built, and under 60 MB to send."""
    import pickle
    import random
    import tracemalloc
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(50_000)]
    rows = [(str(i), " ".join(rng.choice(vocab) for _ in range(200))) for i in range(2500)]
    tracemalloc.start()
    p = D.Patterns(rows, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 * len(rows) / 2500 and len(pickle.dumps(p)) < 60e6
    assert len(p.tables) == 1 and len(p.tables[0].at) == 2500 * 191


def test_equal_windows_are_one_pattern_with_all_items():
    rows = [("a", "x y z"), ("b", "X  y, z!"), ("c", None), ("a", "x y z"), ("d", "z y x q")]
    p = D.Patterns(rows, 3)
    t = p.tables[0]
    assert sorted(t.text(k).decode() for k in range(len(t.at))) == ["x y z", "y x q", "z y x"]
    k = [t.text(i) for i in range(len(t.at))].index(b"x y z")
    assert sorted(set(t.items(k))) == [0, 1]
