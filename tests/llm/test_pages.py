import random

import pytest

from ledgerscope.llm import pages as P


def page(body, i, host="a.example.com", extra=""):
    return (f"<!DOCTYPE html><html><head><title>T {i}</title><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li><a href='/x'>Link {i}</a></li></ul></nav><div class=\"ad box\">Buy {i}</div>"
            f"<div id=wrap><div class='main-col'>{body}</div><div class='side bar'><p>Static sidebar text</p></div>{extra}</div>"
            f"<form><p>Sign up {i}</p></form><section class='comments'><p>Reader {i}</p></section><footer>&copy; {host} {i}</footer></body></html>")


def read(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id bigint, url string, html string, text string, host int")
    return {r.page_id: r for r in P.extract_pages(frame).collect()}


def test_wrapper_finds_the_varying_region(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for i in range(30):
        words = [" ".join(rng.choice(["alpha", "beta", "x&amp;y", "é"]) for _ in range(rng.randrange(15, 40))) for _ in range(rng.randrange(1, 5))]
        body = f"<h1>Title <i>n</i>{i}</h1>" + "".join(f"<p>{w}<br>  more</p>" for w in words) + "<p>Share this page</p>"
        rows.append((i, f"http://{'a' if i % 3 else 'b'}.example.com/p{i}", page(body, i)))
        want[i] = " ".join([f"Title n{i}", *[w.replace("&amp;", "&") + " more" for w in words]])
    got = read(spark, rows)
    assert {i: got[i].text for i in want} == want
    assert all(got[i].n_chars == len(want[i]) for i in want)


def test_edge_cases(spark):
    rows = [(1, "http://solo.example.com/", "<article><h1>A</h1><p><b>bold<br><p>next &lt;x&gt; &#233;</article>"),
            (2, None, None), (3, "http://x/", ""), (4, "nohost", "plain text only"), (5, "http://x/", "<p>cut off &am"),
            (5, "http://x/", "<p>cut off &am"), (6, "http://x/", "<div hidden>no</div><p>yes</p><!-- gone"), (None, "http://y/", "<p>n")]
    got = read(spark, rows)
    assert got[2].text == "" and got[3].text == "" and got[4].text == "plain text only"
    assert got[1].text == "A bold next <x> é"
    assert got[5].text == "cut off &am" and got[6].text == "yes" and got[None].text == "n"


def test_copies_of_one_article_are_content(spark):
    text = "The same article everywhere, again and again."
    rows = [(i, "http://c.example.com/", page(f"<article><p>{text}</p></article>", i)) for i in range(12)]
    assert {r.text for r in read(spark, rows).values()} == {text}


def test_layout_too_rare_for_a_sample_has_its_own_wrapper(spark):
    rng = random.Random(1)
    words = lambda: " ".join(rng.choice(["red", "blue", "green", "grey", "pink"]) + str(rng.randrange(99)) for _ in range(30))
    rows, want = [], {}
    for i in range(120):
        want[i] = f"{words()} {words()}"
        a, b = want[i][:len(want[i]) // 2], want[i][len(want[i]) // 2:]
        body = (f"<div class=main><p>{a}</p><p>{b}</p><p>Fixed words of the main layout</p></div>" if i % 20 else
                f"<table class=story><tr><td><p>{a}</p><p>{b}</p><p>Other fixed words</p></td></tr></table><div class=low><p>Call us now</p></div>")
        want[i] = f"{a.strip()} {b.strip()}"
        rows.append((i, "http://d.example.com/", f"<html><body><div class=top>Site name</div>{body}</body></html>"))
    got = read(spark, rows)
    assert {i: got[i].text for i in want} == want


def test_constant_text_of_two_pages(spark):
    body = lambda t: f"<html><body><div class=main><p>{t}</p><p>Call us now</p></div></body></html>"
    rows = [(1, "http://e.example.com/", body("one two three four five six")), (2, "http://e.example.com/", body("seven eight nine ten eleven"))]
    assert [r.text for _, r in sorted(read(spark, rows).items())] == ["one two three four five six", "seven eight nine ten eleven"]


def test_names_do_not_remove_the_varying_text(spark):
    rows, want = [], {}
    for i in range(9):
        want[i] = f"Story {i} has words of its own and a link"
        rows.append((i, "http://f.example.com/", f"<html><body class='has-sidebar'><div class=sidebar>Also read {i}</div>"
                     f"<article class='post comment-open' style='overflow:hidden'><p>Story {i} has words of its own and a "
                     f"<a href='?id=news-search'>link</a></p></article></body></html>"))
    rows += [(20, "http://g.example.com/", "<div class=share><p>All there is</p></div>"), (21, "http://g.example.com/", "<p data-id=search>x</p>")]
    got = read(spark, rows)
    assert {i: got[i].text for i in want} == want
    assert got[20].text == "All there is" and got[21].text == "x"


def test_empty(spark):
    assert read(spark, []) == {}


def tree_of(source):
    parents, keys, pieces = P.flatten(P.parse(source))
    own = {}
    for block, _, piece in pieces:
        own[block] = own.get(block, "") + piece
    return P.Tree(parents, keys, [P.hash64(own[k]) if own.get(k, "").strip() else 0 for k in range(len(keys))])


def slow_match(a, b, x=0, y=0):
    if a.keys[x] != b.keys[y]:
        return 0

    def best(p, q):
        if not p or not q:
            return 0
        return max(best(p[1:], q), best(p, q[1:]), best(p[1:], q[1:]) + slow_match(a, b, p[0], q[0]))

    return 1 + (a.texts[x] != 0 and a.texts[x] == b.texts[y]) + best(a.kids[x], b.kids[y])


@pytest.mark.parametrize("seed", range(12))
def test_simple_tree_matching(seed):
    rng = random.Random(seed)

    def tree(depth):
        tag = rng.choice(["div", "section", "ul"])
        text = rng.choice(["", "", "fixed", "other"])
        return f"<{tag}>{text}" + "".join(tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)) + f"</{tag}>"

    a, b = tree_of(tree(3)), tree_of(tree(3))
    size, pairs = P.match_trees(a, b)
    assert size == slow_match(a, b)
    assert size == len(pairs) + sum(a.texts[x] != 0 and a.texts[x] == b.texts[y] for x, y in pairs)
    assert all(a.keys[x] == b.keys[y] for x, y in pairs)
    assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
    assert all((a.parents[x], b.parents[y]) in pairs for x, y in pairs if x)


def test_long_lists_are_matched_in_order(monkeypatch):
    a, b = tree_of("<ul>" + "<p></p><h2><p></p></h2>" * 6 + "</ul>"), tree_of("<ul>" + "<h2><p></p></h2><p></p>" * 6 + "</ul>")
    monkeypatch.setattr(P, "MOST_PAIRS", 4)
    size, pairs = P.match_trees(a, b)
    assert size == len(pairs) > 8 and all(a.keys[x] == b.keys[y] for x, y in pairs)


def test_long_lists_get_the_largest_match(monkeypatch):
    """The match of a child list does not depend on its length, nor on how much of the table is held."""
    late = "<h2><i></i></h2>" + "<p></p><h3></h3>" * 9
    a, b = tree_of("<ul>" + late + "</ul>"), tree_of("<ul>" + "<p></p><h3></h3>" * 9 + "<h2><p></p></h2></ul>")
    want = P.match_trees(a, b)
    assert want[0] == 20
    for most in (0, 4, 60, 200):
        monkeypatch.setattr(P, "MOST_PAIRS", most)
        assert P.match_trees(a, b) == want


def test_collapse_joins_runs_of_leaves_only():
    parents, keys, node = P.collapse(*P.flatten(P.parse("<div><p>a<p>b<p>c<ul><li>x</ul><p>d</div><div><p>e</div>"))[:2])
    assert keys == ["", "div", "p", "ul", "li", "p", "div", "p"]
    assert parents == [-1, 0, 1, 1, 3, 1, 0, 6]
    assert node == [0, 1, 2, 2, 2, 3, 4, 5, 6, 7]


def test_deep_and_long_markup(spark):
    deep = "<div>" * 5000 + "deep words" + "</div>" * 5000
    open_ = "<b>" * 4000 + "bold"
    long = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(30_000)) + "</article>"
    got = read(spark, [(1, "http://h.example.com/1", deep), (2, "http://h.example.com/2", open_), (3, "http://h.example.com/3", long)])
    assert got[1].text == "deep words" and got[2].text == "bold"
    assert got[3].text == " ".join(f"paragraph {i}" for i in range(30_000))


def plain_wrapper(rows):
    """Brute force: one list per host and path of all pages, texts on nine tenths of the pages with the path are template."""
    seen, having = {}, {}
    pages = {}
    for i, html in rows:
        parents, keys, pieces = P.flatten(P.parse(html))
        path = []
        for p, k in zip(parents, keys):
            path.append("" if p < 0 else f"{path[p]}/{k}")
        own = {}
        for block, _, piece in pieces:
            own[block] = own.get(block, "") + piece
        blocks = [(path[k], " ".join(t.split())) for k, t in sorted(own.items()) if t.strip()]
        pages[i] = blocks
        for b in set(blocks):
            seen[b] = seen.get(b, 0) + 1
        for p in set(path):
            having[p] = having.get(p, 0) + 1
    return {i: " ".join(t for p, t in blocks if 10 * seen[p, t] < 9 * having[p]) for i, blocks in pages.items()}


def test_counts_alone_find_the_content(spark):
    """Without any names: what the alignment calls varying is the content, as a plain count over the host's pages says."""
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["rot", "blau", "grau", "grün"]) + str(rng.randrange(999)) for _ in range(n))
    rows = []
    for i in range(40):
        body = "".join(f"<p>{words(12)}</p>" for _ in range(rng.randrange(2, 7)))
        if i % 5 == 0:
            body = f"<h2>{words(3)}</h2><table><tr><td>{words(9)}</td></tr></table>" + body
        rows.append((i, f"<html><body><div><ul><li>Home</li><li>About us</li></ul></div><div><section>{body}<p>Read more soon</p></section></div>"
                        f"<div><p>All rights are ours</p><p>Call 555</p></div></body></html>"))
    frame = spark.createDataFrame([(i, "http://n.example.com/", h) for i, h in rows], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in P.extract_pages(frame, names=False).collect()}
    assert got == plain_wrapper(rows)


def test_query_on_given_pages(spark, tmp_path):
    rows = [(i, f"http://q{i % 3}.example.com/", page(f"<article><h1>T{i}</h1><p>Own words of page {i} here</p></article>", i)) for i in range(30)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = P.pages_query(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(i, t, len(t)) for i in range(30) for t in [f"T{i} Own words of page {i} here"]]
