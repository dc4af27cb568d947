"""Main text of web pages by wrapper induction: simple tree matching over the pages of a host.

Every page is parsed once to a DOM tree and flattened: block nodes in page
order, and the pieces of text with the block that owns them. Runs of leaf
siblings of one kind are one node (a list of paragraphs is one slot, however long).
Pages with the same tree form a layout.

The most frequent layout of a host is its reference tree. Every other layout is
aligned with it by simple tree matching, an order-preserving match of
largest size; a matched node takes the reference's slot, another one the slot
of its parent's slot and its kind. How many pages hold a text in a slot is
counted over all pages of the host. A text on nine tenths of a layout's pages, or
of the host's pages that have its slot, is template if these are two or
more; all other text varies and is content.

The wrapper of a layout follows from these counts: the region whose slots hold the
varying text, outside blocks named as navigation, adverts, forms and the like,
and the template texts in it. A block with such a name stays where the counts show
that it holds most varying text. Pages are then read with their layout's wrapper.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.llm.store import write_table

CONSTANT_PERCENT = 90
# cells of a match table that are held at a time; the match does not depend on it
MOST_PAIRS = 1 << 22
IN_REGION, ON_PAGE, UNLESS_TAG = 1, 2, 4
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s\"'>]+))?")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
LEAF_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "dt", "dd", "td", "th", "figcaption"}
NO_TEXT = {"script", "style", "noscript", "template", "iframe", "head", "title", "button", "select", "textarea", "svg", "object", "xmp"}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
BOILER = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment",
          "comments", "cookie", "cookies", "consent", "disclaimer", "footer", "header", "masthead", "menu", "modal", "nav",
          "navbar", "navigation", "newsletter", "notice", "notification", "popup", "promo", "promotion", "related", "reply",
          "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
          "disqus", "contentinfo", "complementary", "alert", "search"}


class Node:
    __slots__ = ("key", "tag", "gone", "named", "parts")

    def __init__(self, tag: str, key: str, gone: bool, named: bool):
        self.tag, self.key, self.gone, self.named, self.parts = tag, key, gone, named, []

    def inline(self) -> bool:
        """Whether the node is part of its block's text."""
        return self.tag in INLINE and not self.named


def make_node(tag: str, attrs: str) -> Node:
    """Node with its alignment key (tag and class words without digits), whether it never shows and whether it is boilerplate by name."""
    words, hidden = [], False
    if attrs and "=" in attrs or "hidden" in attrs:
        for name, value in ATTR.findall(attrs):
            name = name.lower()
            if name == "hidden" or name == "aria-hidden" and "true" in value.lower():
                hidden = True
            elif name in ("class", "id", "role"):
                words += re.split(r"[^a-z]+", value.lower())
    words = [w for w in words if w]
    key = tag + "".join("." + w for w in words)
    return Node(tag, key, hidden or tag in NO_TEXT, named(key))


def named(key: str) -> bool:
    """Whether an alignment key names boilerplate."""
    tag, *words = key.split(".")
    return tag in BOILER_TAGS or any(w in BOILER for w in words)


def parse(source: str) -> Node:
    """Forgiving DOM: unclosed and crossed tags are closed where their parent ends; text is decoded."""
    root = Node("", "", False, False)
    stack, at = [root], 0
    while at < len(source):
        m = TOKEN.search(source, at)
        if m is None:
            stack[-1].parts.append(entities.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(entities.unescape(source[at:m.start()]))
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    # an inline end tag does not close the blocks around it
                    if tag not in INLINE or all(n.tag in INLINE for n in stack[k:]):
                        del stack[k:]
                    break
            continue
        if tag not in INLINE and tag not in VOID:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        node = make_node(tag, m[3] or "")
        stack[-1].parts.append(node)
        if tag in VOID or (m[3] or "").endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        stack.append(node)
    return root


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def flatten(root: Node) -> tuple[list[int], list[str], list[tuple[int, int, str]]]:
    """Parents and keys of the block nodes in page order, and (block, line, piece) of all text that may show."""
    parents, keys, pieces, line = [-1], [""], [], 0
    stack = [(iter(root.parts), 0, True)]
    while stack:
        parts, at, solid = stack[-1]
        for p in parts:
            if isinstance(p, str):
                pieces.append((at, line, p))
            elif p.gone:
                continue
            elif p.tag == "br":
                pieces.append((at, line, " "))
            elif p.inline():
                stack.append((iter(p.parts), at, False))
                break
            elif p.tag in VOID:
                line += p.tag not in INLINE
            else:
                line += p.tag not in INLINE
                parents.append(at)
                keys.append(p.key)
                stack.append((iter(p.parts), len(keys) - 1, p.tag not in INLINE))
                break
        else:
            stack.pop()
            line += solid
    return parents, keys, pieces


def collapse(parents: list[int], keys: list[str]) -> tuple[list[int], list[str], list[int]]:
    """The tree with runs of equal leaf siblings as one node each, and the new node of every old one."""
    leaf = [True] * len(keys)
    for p in parents[1:]:
        leaf[p] = False
    last = [-1] * len(keys)
    new, out_parents, out_keys = [0] * len(keys), [-1], [""]
    for i in range(1, len(keys)):
        p = parents[i]
        before = last[p]
        last[p] = i
        if leaf[i] and before > 0 and leaf[before] and keys[before] == keys[i]:
            new[i] = new[before]
            continue
        new[i] = len(out_keys)
        out_parents.append(new[p])
        out_keys.append(keys[i])
    return out_parents, out_keys, new


class Tree:
    """Collapsed tree of a layout: parents, keys and a hash of each node's own text on one of its pages (0: none)."""

    def __init__(self, parents: list[int], keys: list[str], texts: list[int]):
        self.parents, self.keys, self.texts = parents, keys, texts
        self.kids: list[list[int]] = [[] for _ in keys]
        for i, p in enumerate(parents):
            if p >= 0:
                self.kids[p].append(i)


class Shapes:
    """Subtrees of a tree, numbered: subtrees of one kind, text and subtrees below share a number.

    ``kinds`` and ``texts`` number block kinds and the texts that both trees hold
    (0: any other text), so that numbers can be compared across the two trees.
    """

    def __init__(self, tree: Tree, kinds: dict[str, int], texts: dict[int, int]):
        known: dict[tuple, int] = {}
        self.of = [0] * len(tree.keys)
        kind, text, self.kids, self.height = [], [], [], []
        for k in range(len(tree.keys) - 1, -1, -1):
            below = tuple(self.of[c] for c in tree.kids[k])
            own = kinds.setdefault(tree.keys[k], len(kinds)), texts.get(tree.texts[k], 0), below
            self.of[k] = known.setdefault(own, len(known))
            if len(known) > len(self.kids):
                kind.append(own[0])
                text.append(own[1])
                self.kids.append(below)
                self.height.append(1 + max((self.height[c] for c in below), default=0))
        self.kind, self.text = np.array(kind, np.int64), np.array(text, np.int64)


def next_best(best: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Largest total weights with one more left item, by number of right items; ``weight`` is its row (0: must not match)."""
    out = np.zeros_like(best)
    np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weight), out=out[1:])
    return out


def best_match(row, n: int, m: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of an order-preserving match of largest total weight; ``row(i)`` has the weights of left item i.

    About ``MOST_PAIRS`` cells of the table are held at a time, besides one row in every
    block of rows from which the block is computed again on the way back.
    """
    block = max(1, MOST_PAIRS // (m + 1))
    saved = [np.zeros(m + 1, np.int64)]
    best = saved[0]
    for i in range((n - 1) // block * block):
        best = next_best(best, row(i))
        if (i + 1) % block == 0:
            saved.append(best)
    i, j, out = n, m, []
    while saved and i and j:
        low = (len(saved) - 1) * block
        table = [saved.pop()]
        for k in range(low, i):
            table.append(next_best(table[-1], row(k)))
        while i > low and j:
            here, above = table[i - low], table[i - low - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
    return out[::-1]


def match_trees(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest order-preserving match of two trees, and its pairs of nodes.

    Equal texts of matched nodes count as one more matched node, so that fixed
    blocks align with themselves. The match is the largest one whatever the number of
    children; equal subtrees are compared once. Without recursion, however deep the trees are.
    """
    if a.keys[0] != b.keys[0]:
        return 0, []
    kinds: dict[str, int] = {}
    texts = {t: k for k, t in enumerate(sorted(set(a.texts) & set(b.texts) - {0}), 1)}
    left, right = Shapes(a, kinds, texts), Shapes(b, kinds, texts)
    todo = [(left.of[0], right.of[0])]
    seen = set(todo)
    for p, q in todo:  # pairs of subtrees that both have children
        inner: dict[int, list[int]] = {}
        for o in set(right.kids[q]):
            if right.kids[o]:
                inner.setdefault(int(right.kind[o]), []).append(o)
        for k in set(left.kids[p]) if inner else ():
            if left.kids[k]:
                more = [(k, o) for o in inner.get(int(left.kind[k]), ()) if (k, o) not in seen]
                todo += more
                seen.update(more)
    size: dict[tuple[int, int], int] = {}

    def rows(p: int, q: int):
        """Weights of a child of p with every child of q: sizes of their matches, 0 for different kinds."""
        ks = left.kids[p]
        at = np.array(right.kids[q], np.int64)
        kind, text = right.kind[at], right.text[at]
        inner: dict[int, list[tuple[int, int]]] = {}
        for j, o in enumerate(right.kids[q]):
            if right.kids[o]:
                inner.setdefault(int(right.kind[o]), []).append((j, o))
        made: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            k = ks[i]
            weight = made.get(k)
            if weight is None:
                same = kind == left.kind[k]
                weight = same.astype(np.int64)
                if left.text[k]:
                    weight += same & (text == left.text[k])
                if left.kids[k]:
                    for j, o in inner.get(int(left.kind[k]), ()):
                        weight[j] = size[k, o]
                if len(made) * len(at) < MOST_PAIRS:
                    made[k] = weight
            return weight

        return row

    for p, q in sorted(todo, key=lambda pair: left.height[pair[0]]):
        best = np.zeros(len(right.kids[q]) + 1, np.int64)
        if len(left.kids[p]) == len(right.kids[q]) == 1:
            k, o = left.kids[p][0], right.kids[q][0]
            if left.kind[k] == right.kind[o]:
                best[1] = size[k, o] if left.kids[k] and right.kids[o] else 1 + (left.text[k] != 0 and left.text[k] == right.text[o])
        elif left.kids[p] and right.kids[q]:
            row = rows(p, q)
            for i in range(len(left.kids[p])):
                best = next_best(best, row(i))
        size[p, q] = 1 + int(left.text[p] != 0 and left.text[p] == right.text[q]) + int(best[-1])
    matched = [(0, 0)]
    for x, y in matched:
        if a.kids[x] and b.kids[y]:
            found = best_match(rows(left.of[x], right.of[y]), len(a.kids[x]), len(b.kids[y]))
            matched += [(a.kids[x][i], b.kids[y][j]) for i, j in found]
    return size[left.of[0], right.of[0]], matched


def slots_of(tree: Tree, reference: Tree) -> list[int]:
    """Slot of every node: the matched reference node, or a hash of the parent's slot and the node's kind."""
    slots = [-1] * len(tree.keys)
    for x, y in match_trees(tree, reference)[1]:
        slots[x] = y
    for k, p in enumerate(tree.parents):
        if slots[k] < 0:
            slots[k] = hash64(f"{slots[p]}/{tree.keys[k]}") | 1 << 62
    return slots


def induce(parents: list[int], keys: list[str], varying: list[float], total: list[float], fixed: list[tuple[int, int]],
           names: bool = True) -> tuple[list[int], list[tuple[int, int]]]:
    """Wrapper of a layout: what shows of each node (bits), and its template texts as (node, text hash).

    ``varying`` and ``total`` are the mean characters of each node's slot, over the
    host's pages that have it, without the blocks inside. ``names`` tells
    whether the name list counts.
    """
    n = len(keys)
    by_name = [names and k > 0 and named(key) for k, key in enumerate(keys)]
    kept = [False] * n

    def shown() -> list[bool]:
        out = [True] * n
        for k in range(1, n):
            out[k] = out[parents[k]] and (not by_name[k] or kept[k])
        return out

    def below(values: list[float]) -> list[float]:
        out = list(values)
        for k in range(n - 1, 0, -1):
            out[parents[k]] += out[k]
        return out

    all_below = below(varying)
    shows = shown()
    for k in range(1, n):
        if by_name[k] and shows[parents[k]] and 2 * all_below[k] > all_below[0] and \
                all_below[k] > sum(t for t, s in zip(total, shows) if s):
            kept[k] = True
            shows = shown()
    values = [v if s else 0.0 for v, s in zip(varying, shows)]
    if not any(values):  # copies of one page: nothing varies, so everything counts
        values = [t if s else 0.0 for t, s in zip(total, shows)]
    weight = below(values)
    kids: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        kids[parents[k]].append(k)
    region = 0
    while True:
        inner = [k for k in kids[region] if shows[k]]
        if not inner:
            break
        k = max(inner, key=lambda c: weight[c])
        tag = keys[k].split(".")[0]
        if tag in LEAF_BLOCKS or tag in INLINE or weight[k] <= 0.6 * weight[region]:
            break
        region = k
    inside = [False] * n
    inside[region] = True
    for k in range(region + 1, n):
        inside[k] = inside[parents[k]]
    held = [(varying[k], total[k]) for k in range(n) if inside[k] and shows[k]]
    # copies of one article align to a constant region: then nothing in it is template
    if 2 * sum(t - v for v, t in held) > sum(t for _, t in held):
        fixed = []
    tagged = [True] * n
    for k in range(1, n):
        tagged[k] = tagged[parents[k]] and (not by_name[k] or kept[k] or keys[k].split(".")[0] not in BOILER_TAGS)
    bits = [IN_REGION * (shows[k] and inside[k]) | ON_PAGE * shows[k] | UNLESS_TAG * tagged[k] for k in range(n)]
    return bits, sorted((k, t) for k, t in fixed if inside[k] and shows[k])


def main_text(pieces: list[tuple[int, int, int, str]], bits: list[int], fixed: set[tuple[int, int]]) -> str:
    """Text of (node, text hash, line, piece) as the wrapper shows it; the whole body where that gives none."""
    for bit in (IN_REGION, ON_PAGE, UNLESS_TAG):
        out: list[str] = []
        last = None
        for node, text, line, piece in pieces:
            if bits[node] & bit and not (bit == IN_REGION and (node, text) in fixed):
                if line == last:
                    out[-1] += piece
                else:
                    out.append(piece)
                    last = line
        found = " ".join(" ".join(out).split())
        if found:
            return found
    return ""


def host_of(url: str = "url") -> Column:
    """Host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


TREE = "parents array<int>, keys array<string>"
BLOCKS = "array<struct<node:int,text:bigint,n:bigint>>"


def read_pages(pages: DataFrame) -> DataFrame:
    """Every page as layout, texts by block and pieces; ``pages`` has page_id, url, host, html and digest.

    A task gives the tree of a layout with the first page it meets of it.
    """

    def run(batches):
        met = set()
        for b in batches:
            layouts, trees, pieces, width = [], ([], [], [0]), ([], [], []), [0]
            blocks, blocks_to = ([], [], []), [0]
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                if not source:
                    layouts.append(None)
                    trees[2].append(len(trees[0]))
                    width.append(len(pieces[0]))
                    blocks_to.append(len(blocks[0]))
                    continue
                parents, keys, found = flatten(parse(source))
                own: dict[int, list] = {}
                for block, line, piece in found:
                    own.setdefault(block, []).append((line, piece))
                short_parents, short_keys, node = collapse(parents, keys)
                mark, size = {}, {}
                for block, parts in own.items():
                    # a break to another block parts the words
                    text = " ".join("".join(piece if k == 0 or parts[k - 1][0] == line else " " + piece
                                            for k, (line, piece) in enumerate(parts)).split())
                    mark[block] = hash64(text) if text else 0
                    if text:
                        key = node[block], mark[block]
                        size[key] = size.get(key, 0) + len(text)
                layout = hash64("\n".join(f"{p} {k}" for p, k in zip(short_parents, short_keys)))
                layouts.append(layout)
                if (host, layout) not in met:
                    if len(met) > 10_000:
                        met.clear()
                    met.add((host, layout))
                    trees[0].extend(short_parents)
                    trees[1].extend(short_keys)
                trees[2].append(len(trees[0]))
                place = {key: k for k, key in enumerate(size)}
                for (k, text), n in size.items():
                    blocks[0].append(k)
                    blocks[1].append(text)
                    blocks[2].append(n)
                blocks_to.append(len(blocks[0]))
                for block, line, piece in found:
                    if mark[block]:
                        pieces[0].append(place[node[block], mark[block]])
                        pieces[1].append(line)
                        pieces[2].append(piece)
                width.append(len(pieces[0]))
            cuts = pa.array(trees[2], pa.int32())
            types = (pa.int32(), pa.int32(), pa.string())
            part = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(pieces, types)], ["block", "line", "piece"])
            block = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(blocks, (pa.int32(), pa.int64(), pa.int64()))], ["node", "text", "n"])
            yield pa.RecordBatch.from_pydict({
                **{c: b.column(c) for c in ("page_id", "url", "host", "digest")}, "layout": pa.array(layouts, pa.int64()),
                "parents": pa.ListArray.from_arrays(cuts, pa.array(trees[0], pa.int32())),
                "keys": pa.ListArray.from_arrays(cuts, pa.array(trees[1], pa.string())),
                "blocks": pa.ListArray.from_arrays(pa.array(blocks_to, pa.int32()), block),
                "pieces": pa.ListArray.from_arrays(pa.array(width, pa.int32()), part)})

    page_id = f"page_id {pages.schema['page_id'].dataType.simpleString()}"
    return pages.mapInArrow(run, f"{page_id}, url string, host string, digest bigint, layout bigint, {TREE}, "
                                 f"blocks {BLOCKS}, pieces array<struct<block:int,line:int,piece:string>>")


def align_layouts(layouts: DataFrame) -> DataFrame:
    """host, layout and the slots of its nodes; ``layouts`` has host, layout, pages, its tree and the blocks of one page."""
    tree = F.struct("parents", "keys", "blocks")
    # the most frequent layout of a host, of those the smallest
    reference = layouts.groupBy("host").agg(F.max_by(tree, F.struct("pages", -F.size("keys"), "layout")).alias("reference"))

    def tree_of(parents, keys, blocks):
        texts = [0] * len(keys)
        for x in blocks:
            texts[x["node"]] = texts[x["node"]] or x["text"]
        return Tree(parents, keys, texts)

    def run(batches):
        for b in batches:
            out = []
            for k in range(b.num_rows):
                own = tree_of(*(b.column(c)[k].as_py() for c in ("parents", "keys", "blocks")))
                out.append(slots_of(own, tree_of(**b.column("reference")[k].as_py())))
            yield pa.RecordBatch.from_pydict({"host": b.column("host"), "layout": b.column("layout"),
                                              "slots": pa.array(out, pa.list_(pa.int64()))})

    return layouts.join(reference, "host").select("host", "layout", "parents", "keys", "blocks", "reference").mapInArrow(
        run, "host string, layout bigint, slots array<bigint>")


def slot_texts(single: DataFrame, slots: DataFrame) -> DataFrame:
    """host, layout, slot, text, n of every page; a text that a page repeats in one slot is one row."""

    def run(batches):
        for b in batches:
            rows, keys, sums = [], ([], []), []
            for k, (blocks, slot) in enumerate(zip(b.column("blocks").to_pylist(), b.column("slots").to_pylist())):
                found: dict[tuple[int, int], int] = {}
                for x in blocks:
                    key = slot[x["node"]], x["text"]
                    found[key] = found.get(key, 0) + x["n"]
                rows += [k] * len(found)
                keys[0].extend(s for s, _ in found)
                keys[1].extend(t for _, t in found)
                sums += found.values()
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "host": b.column("host").take(at), "layout": b.column("layout").take(at), "slot": pa.array(keys[0], pa.int64()),
                "text": pa.array(keys[1], pa.int64()), "n": pa.array(sums, pa.int64())})

    return single.join(slots, ["host", "layout"]).select("host", "layout", "blocks", "slots").mapInArrow(
        run, "host string, layout bigint, slot bigint, text bigint, n bigint")


def learn_wrappers(read: DataFrame, names: bool = True) -> DataFrame:
    """host, layout, bits and template texts of every layout, from all pages as ``read_pages`` gives them."""
    key = ["host", "layout"]
    own = read.where("layout IS NOT NULL")
    # copies of a page count once
    single = write_table(own.groupBy(*key, "digest").agg(F.first("blocks").alias("blocks")), "page-blocks")
    trees = own.where("size(keys) > 0").groupBy(*key).agg(F.first(F.struct("parents", "keys")).alias("tree"))
    sizes = single.groupBy(*key).agg(F.count("*").alias("pages"), F.min_by("blocks", "digest").alias("blocks"))
    layouts = write_table(trees.join(sizes, key).select(*key, "pages", "tree.*", "blocks"), "layouts")
    slots = write_table(align_layouts(layouts), "layout-slots")
    nodes = slots.select(*key, F.posexplode("slots").alias("node", "slot"))
    holders = slots.join(layouts.select(*key, "pages"), key).select("host", "pages", F.explode(F.array_distinct("slots")).alias("slot")) \
        .groupBy("host", "slot").agg(F.sum("pages").alias("holders"))
    texts = slot_texts(single, slots).groupBy(*key, "slot", "text").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n"))
    texts = write_table(texts, "slot-texts")
    on_host = texts.groupBy("host", "slot", "text").agg(F.sum("n_pages").alias("on_host"))
    often = lambda n, of: (F.col(of) > 1) & (100 * F.col(n) >= CONSTANT_PERCENT * F.col(of))
    texts = texts.join(on_host, ["host", "slot", "text"]).join(holders, ["host", "slot"]).join(layouts.select(*key, "pages"), key).select(
        *key, "slot", "text", "n", "holders", (often("n_pages", "pages") | often("on_host", "holders")).alias("constant"))
    size = texts.groupBy("host", "slot").agg(
        (F.sum(F.when(~F.col("constant"), F.col("n")).otherwise(0)) / F.first("holders")).alias("varying"),
        (F.sum("n") / F.first("holders")).alias("n"))
    # a layout's lists are no longer than a page of it
    sized = nodes.join(size, ["host", "slot"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        "node", F.coalesce("varying", F.lit(0.0)).alias("varying"), F.coalesce("n", F.lit(0.0)).alias("n")))).alias("sizes"))
    fixed = texts.where("constant").join(nodes.select(*key, "slot", "node"), [*key, "slot"]).groupBy(*key).agg(
        F.collect_list(F.struct("node", "text")).alias("fixed"))

    def learn(batches):
        for b in batches:
            bits, constant = [], []
            for p, k, s, c in zip(*(b.column(x).to_pylist() for x in ("parents", "keys", "sizes", "fixed"))):
                one, two = induce(p, k, [x["varying"] for x in s], [x["n"] for x in s], [(x["node"], x["text"]) for x in c or []], names)
                bits.append(one)
                constant.append([{"node": n, "text": t} for n, t in two])
            yield pa.RecordBatch.from_pydict({
                "host": b.column("host"), "layout": b.column("layout"), "bits": pa.array(bits, pa.list_(pa.int32())),
                "fixed": pa.array(constant, pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64())])))})

    return write_table(layouts.join(sized, key).join(fixed, key, "left").select(*key, "parents", "keys", "sizes", "fixed").mapInArrow(
        learn, "host string, layout bigint, bits array<int>, fixed array<struct<node:int,text:bigint>>"), "wrappers")


def extract_pages(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    White space inside a block becomes one space, blocks are joined by one
    space in page order, character references are decoded. Defined cases: null
    or empty html gives an empty text; broken, cut-off and deeply nested markup
    is read as far as it goes; a page whose region gives no text is read as its
    whole body, at last with the nodes that ``BOILER`` names; a null or
    hostless url counts as one host; copies of a page's html count once, repeated
    rows are read one by one; other columns are ignored. ``names`` off, the
    wrapper goes by the counts alone.
    """
    rows = pages.select("page_id", "url", "html", host_of().alias("host"), F.xxhash64("html").alias("digest"))
    read = write_table(read_pages(rows), "pages-read")
    wrappers = learn_wrappers(read, names)

    def show(batches):
        for b in batches:
            texts = []
            bits, fixed = b.column("bits"), b.column("fixed")
            pieces, blocks = b.column("pieces"), b.column("blocks")
            start = pieces.offsets.to_numpy()
            block, line, piece = (pieces.values.field(c) for c in ("block", "line", "piece"))
            for k in range(b.num_rows):
                if not bits[k].is_valid:
                    texts.append("")
                    continue
                s, n = int(start[k]), int(start[k + 1] - start[k])
                owners = [(x["node"], x["text"]) for x in blocks[k].as_py()]
                parts = [(*owners[o], at, t) for o, at, t in zip(*(x.slice(s, n).to_pylist() for x in (block, line, piece)))]
                texts.append(main_text(parts, bits[k].as_py(), {(x["node"], x["text"]) for x in fixed[k].as_py()}))
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string())})

    page_id = f"page_id {pages.schema['page_id'].dataType.simpleString()}"
    out = read.select("page_id", "url", "host", "layout", "blocks", "pieces").join(wrappers, ["host", "layout"], "left").select(
        "page_id", "url", "blocks", "pieces", "bits", "fixed").mapInArrow(show, f"{page_id}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def pages_query(spark, sf_dir: str) -> DataFrame:
    """op8: main text of every page."""
    from ledgerscope.sources.tables import read_table
    return extract_pages(read_table(spark, sf_dir, "pages"))


PAGES_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
t AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(body, '</?(a|abbr|b|big|cite|code|em|i|mark|q|s|small|span|strong|sub|sup|u)(\s[^>]*)?>', '', 'g'),
                        '<[^>]*>', ' ', 'g') AS raw
  FROM a),
e AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
           raw, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
  FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM e
"""
