import random

from ledgerscope.llm import neardup as N


def shingles(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, percent=80):
    sets = [shingles(t, k) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            low[r] = min(d, low.get(r, d))
    return sorted([(d, len(s), low.get(find(i)), low.get(find(i)) == d) for i, ((d, _), s) in enumerate(zip(docs, sets))], key=repr)


def run(docs_of, docs, k):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs_of(docs), k).collect()], key=repr)


def edited(rng, words, n, vocab):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(vocab)
    return out


def family(seed, sizes, edits, vocab_size=2000):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocab_size)]
    docs, i = [], 0
    for length, copies in sizes:
        base = [rng.choice(vocab) for _ in range(length)]
        for _ in range(copies):
            docs.append((i, " ".join(edited(rng, base, rng.randrange(edits), vocab))))
            i += 1
    rng.shuffle(docs)
    return docs


def test_matches_brute_force(docs_of):
    docs = family(1, [(200, 6), (90, 5), (30, 6), (8, 4), (3, 4), (1, 3)] + [(60, 1)] * 40, 12)
    docs += [(900, None), (901, ""), (902, " "), (903, docs[0][1].upper()), (903, docs[0][1].upper()), (None, docs[0][1]), (None, "lonely one here")]
    for k in (2, 5):
        assert run(docs_of, docs, k) == brute(docs, k)


def test_large_family_around_the_threshold(docs_of):
    docs = family(2, [(150, 400)], 30)
    assert run(docs_of, docs, 2) == brute(docs, 2)


def test_empty_table(docs_of):
    assert run(docs_of, [], 5) == []


def test_one_of_each_group_stays(docs_of):
    docs = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B C D E F G"), (4, None), (5, "other words are in this one")]
    left = N.drop_near_duplicates(docs_of(docs))
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5]
    assert left.columns == docs_of(docs).columns


def test_repeated_rows_and_shared_ids_leave_one(docs_of):
    docs = [(1, "a b c d e f g")] * 3 + [(1, "A b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (4, None), (4, None)]
    docs += [(None, "no id at all here it is")] * 2 + [(None, "nor has this one any id")] * 2
    left = N.drop_near_duplicates(docs_of(docs))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "4", "None", "None"]
    assert len({r.text for r in left.collect() if r.doc_id is None}) == 2
    assert left.columns == docs_of(docs).columns


def test_block_links_join_pieces(spark):
    import numpy as np
    u = lambda *x: np.array(sorted(x), np.uint64)
    left = [(1, 1, u(1, 2, 3, 4, 5)), (2, 2, u(7, 8))]
    right = [(3, 3, u(1, 2, 3, 4, 5)), (4, 3, u(1, 2, 3, 4, 5)), (5, 5, u(9,))]
    assert N.block_links(left, right, 80) == [(1, 3)]


def test_blocks_bounded_by_bytes_give_the_same_groups(docs_of, monkeypatch):
    docs = family(11, [(60, 30), (40, 25)], 9)
    want = brute(docs, 2)
    monkeypatch.setattr(N, "BLOCK_BYTES", 700)
    assert run(docs_of, docs, 2) == want


def test_many_copies_of_one_row(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of([(7, text)])
    frame = docs.crossJoin(docs.sparkSession.range(10_000).select("id")).drop("id").union(docs_of([(9, text + " more"), (8, "other words here")]))
    rows = N.near_duplicates(frame, 2).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(tuple(r) for r in rows) == [(7, 7, True, 10_000), (8, 8, True, 1), (9, 7, False, 1)]
