"""Substring dedup by compaction of a De Bruijn graph over token k-mers.

The edges are windows of ``size`` consecutive words. Edges that follow one
another in a text and share an anchor (the smallest hash among the shorter
k-mers of the window) form one path; the path is cut where the anchor
changes, which depends on the words alone, so equal passages are cut at equal
places. Spark joins then compact the graph:

1. Anchors are counted; a path whose anchor is met once holds no repeated
   edge and is left out.
2. Paths are joined by anchor and content. A path met twice or more does not
   branch: all its edges repeat, as one long span.
3. Where an anchor carries different paths, the graph branches. Only there
   the single edges are compared, by the hash of their words.
4. Every span goes back to its source coordinates (document, first and last
   word), where its words are hashed again and compared before removal.

A passage shared by a third of all documents makes long spans and few edges,
all counted by partial aggregates; no group is ever collected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.store import with_fields, write_table
from ledgerscope.llm.textarrays import U64, WordHasher, mix, text_slices, white_space_separators

SIZE = 35
ANCHOR = 12
SLICE_BYTES = 1 << 18
LOW24 = U64((1 << 24) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        extra = width - have
        out = np.minimum(out[:-extra], out[extra:])
    return out


def cut_paths(h: np.ndarray, row: np.ndarray, hasher: WordHasher, size: int, anchor: int):
    """Paths of a slice: (anchor hash, path hash, row, first edge, last edge), positions over the slice's words."""
    n = len(h) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(U64), none.view(U64), none, none, none
    grams = hasher.window_hash(h, anchor)
    spread = []
    step = 1 << 23  # positions fit 24 bits; longer texts are cut in overlapping stretches
    for at in range(0, n, step):
        part = grams[at:at + step + size - anchor]
        place = np.arange(len(part), dtype=U64)
        low = sliding_min((part & ~LOW24) | place, size - anchor + 1)[:min(step, n - at)]
        spread.append((low & LOW24).astype(np.int64) + at)
    lead = np.concatenate(spread)
    edge = np.flatnonzero(row[:n] == row[size - 1:])
    if not len(edge):
        none = np.zeros(0, np.int64)
        return none.view(U64), none.view(U64), none, none, none
    lead = lead[edge]
    new = np.ones(len(edge), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (edge[1:] != edge[:-1] + 1) | (row[edge[1:]] != row[edge[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(edge)) - 1
    lo, hi, at = edge[first], edge[last], lead[first]
    path = mix(hasher.run_hash(h, lo, hi + size) + (at - lo).astype(U64) * U64(0x9FB21C651E98DF25))
    return grams[at], path, row[lo], lo, hi


def paths(documents: DataFrame, size: int, anchor: int) -> DataFrame:
    """Paths of all rows: anchor a, content s, key, first and last edge, anchor offset, times in a row.

    A path that follows itself (a text that says one word over and over) is
    written once, with the number of times.
    """

    def run(batches):
        hasher = WordHasher(white_space_separators())
        for b in batches:
            keys = b.column("key").to_numpy()
            for at, _, data, off in text_slices(b.column("text"), SLICE_BYTES):
                h, row, _, _ = hasher.words(data, off)
                base = np.searchsorted(row, np.arange(len(off)))
                a, s, r, lo, hi = cut_paths(h, row, hasher, size, anchor)
                if not len(a):
                    continue
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (r[1:] != r[:-1]) | (lo[1:] != hi[:-1] + 1)
                f = np.flatnonzero(new)
                last = np.append(f[1:], len(a)) - 1
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(a[f].view(np.int64)), "s": pa.array(s[f].view(np.int64)),
                    "key": pa.array(keys[at + r[f]]), "lo": pa.array((lo[f] - base[r[f]]).astype(np.int32)),
                    "hi": pa.array((hi[last] - base[r[f]]).astype(np.int32)),
                    "unit": pa.array((hi[f] - lo[f] + 1).astype(np.int32)), "c": pa.array((last - f + 1).astype(np.int32))})

    return documents.mapInArrow(run, "a bigint, s bigint, key bigint, lo int, hi int, unit int, c int")


def single_edges(rows: DataFrame, size: int) -> DataFrame:
    """(key, a, e, pos, w) of every edge of the listed paths; ``rows`` has key, text and todo (lo, hi, w, a)."""

    def run(batches):
        hasher = WordHasher(white_space_separators())
        for b in batches:
            keys, todo = b.column("key").to_numpy(), b.column("todo")
            for at, n, data, off in text_slices(b.column("text"), SLICE_BYTES):
                h, row, _, _ = hasher.words(data, off)
                base = np.searchsorted(row, np.arange(n + 1))
                edges = hasher.window_hash(h, size)
                part = todo.slice(at, n)
                owner = np.repeat(np.arange(n), part.value_lengths().to_numpy())
                flat = part.flatten()
                lo, hi, w, a = (flat.field(k).to_numpy() for k in range(4))
                # a row of another document with an equal key may be shorter; the final check drops such spans
                fits = base[owner] + hi + size <= base[owner + 1]
                owner, lo, hi, w, a = owner[fits], lo[fits], hi[fits], w[fits], a[fits]
                width = hi - lo + 1
                pick = np.repeat(np.arange(len(lo)), width)
                pos = np.arange(len(pick)) - np.repeat(np.cumsum(width) - width, width) + lo[pick]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(keys[at + owner[pick]]), "a": pa.array(a[pick]),
                    "e": pa.array(edges[base[owner[pick]] + pos].view(np.int64)),
                    "pos": pa.array(pos.astype(np.int32)), "w": pa.array(w[pick].astype(np.int32))})

    return rows.mapInArrow(run, "key bigint, a bigint, e bigint, pos int, w int")


def cut_out(rows: DataFrame, size: int, anchor: int, as_is: bool) -> DataFrame:
    """n_words, n_removed and kept_text of every row; ``rows`` ends with text and spans (lo, stop, unit, h)."""
    names = [c for c in rows.columns if c not in ("text", "spans")]

    def run(batches):
        hasher = WordHasher(white_space_separators())
        for b in batches:
            n_words, n_removed, kept = [], [], []
            spans = b.column("spans")
            for at, n, data, off in text_slices(b.column("text"), SLICE_BYTES):
                h, row, start, end = hasher.words(data, off)
                base = np.searchsorted(row, np.arange(n + 1))
                count = np.diff(base)
                gone = np.zeros(len(h) + 1, np.int64)
                part = spans.slice(at, n)
                owner = np.repeat(np.arange(n), part.value_lengths().fill_null(0).to_numpy())
                if len(owner):
                    lo, stop, unit, want = (part.flatten().field(k).to_numpy() for k in range(4))
                    first, last = base[owner] + lo, base[owner] + stop
                    ok = last <= base[owner + 1]
                    first, last, unit, want = first[ok], last[ok], unit[ok], want[ok]
                    # source coordinates verify: the words at the span must hash to what repeats
                    have = hasher.run_hash(h, first, first + np.maximum(unit, 1) + size - 1)
                    path = unit > 0
                    if path.any():
                        have[path] = path_hash(hasher, h, have[path], first[path], size, anchor)
                    ok = have.view(np.int64) == want
                    np.add.at(gone, first[ok], 1)
                    np.add.at(gone, last[ok], -1)
                keep = np.cumsum(gone)[:-1] == 0
                removed = count - np.add.reduceat(np.append(keep, False).astype(np.int64), base[:-1]) * (count > 0)
                raw = data.tobytes()
                for k in range(n):
                    if not removed[k]:
                        text = raw[off[k]:off[k + 1]] if as_is else b" ".join(raw[off[k]:off[k + 1]].split())
                    elif removed[k] == count[k]:
                        text = b""
                    else:
                        stay = base[k] + np.flatnonzero(keep[base[k]:base[k + 1]])
                        text = b" ".join([raw[s:e] for s, e in zip(start[stay].tolist(), end[stay].tolist())])
                    kept.append(text.decode("utf-8"))
                n_words += count.tolist()
                n_removed += removed.tolist()
            cols = {c: b.column(c) for c in names}
            empty = b.column("text").is_null().to_numpy(zero_copy_only=False) if as_is else None
            cols |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                     "kept_text": pa.array(kept, pa.string(), mask=empty)}
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(run, with_fields(rows.select(*names).schema, "n_words bigint, n_removed bigint, kept_text string"))


def path_hash(hasher, h, runs, first, size, anchor):
    """Path hash of runs that start at ``first``: adds where the anchor of the first edge stands."""
    grams = hasher.window_hash(h, anchor)
    place = np.arange(size - anchor + 1)
    low = (grams[first[:, None] + place] & ~LOW24).argmin(axis=1)
    return mix(runs + low.astype(U64) * U64(0x9FB21C651E98DF25))


def find_repeats(documents: DataFrame, size: int, anchor: int) -> DataFrame:
    """(key, lo, stop, unit, h): spans of words to remove. ``documents`` has key and text."""
    cut = paths(documents, size, anchor)
    anchors = write_table(cut.groupBy("a").agg(F.sum("c").alias("n")).where("n > 1").select("a"), "repeated-anchors")
    found = write_table(cut.join(anchors, "a"), "paths")
    kinds = write_table(found.groupBy("a", "s").agg(F.sum("c").alias("n")), "path-kinds")
    branching = write_table(kinds.groupBy("a").agg(F.min("n").alias("least")).where("least = 1").select("a"), "branching")
    marked = found.join(kinds, ["a", "s"])
    long_spans = marked.where("n > 1").select(
        "key", "lo", (F.col("hi") + size).alias("stop"), "unit", F.col("s").alias("h"))
    once = marked.where("n = 1").select("key", "lo", "hi", F.lit(1).alias("w"), "a")
    stand_in = found.join(branching, "a", "left_semi").join(kinds.where("n > 1"), ["a", "s"]).groupBy("a", "s").agg(
        F.min(F.struct("key", "lo", "unit")).alias("x")).select(
        "x.key", "x.lo", (F.col("x.lo") + F.col("x.unit") - 1).alias("hi"), F.lit(2).alias("w"), "a")
    todo = once.union(stand_in).groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "w", "a")).alias("todo"))
    edges = write_table(single_edges(documents.join(todo, "key").select("key", "text", "todo"), size), "edges")
    again = edges.groupBy("a", "e").agg(F.sum("w").alias("n")).where("n > 1").select("a", "e")
    short_spans = edges.where("w = 1").join(again, ["a", "e"]).select(
        "key", F.col("pos").alias("lo"), (F.col("pos") + size).alias("stop"), F.lit(0).alias("unit"), F.col("e").alias("h"))
    return long_spans.union(short_spans)


def remove_repeats(documents: DataFrame, size: int = SIZE, anchor: int = ANCHOR, keep: tuple[str, ...] = (),
                   as_is: bool = False) -> DataFrame:
    """Every row without the words of repeated windows.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text, unchanged. A window of ``size``
    consecutive words repeats if its word sequence starts anywhere else, in the
    same document or another; all words of such windows go. Returns doc_id, the
    columns of ``keep``, n_words, n_removed and kept_text (the words that stay,
    joined by one space; with ``as_is``, texts that lose nothing stay as they
    are, null included). Defined cases: a null or empty text has no words and
    an empty kept_text; a text shorter than a window keeps all words; rows that
    repeat a doc_id or a whole row are documents of their own, so exact copies of
    ``size`` words or more lose everything; other columns are ignored.
    """
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    key = F.xxhash64("doc_id", "text").alias("key")
    spans = find_repeats(documents.select(key, "text"), size, anchor)
    # repeated rows have one key and the same spans, so the list of a key is bounded by its text
    spans = write_table(spans.distinct(), "spans").groupBy("key").agg(F.collect_list(F.struct("lo", "stop", "unit", "h")).alias("spans"))
    body = F.col("text")
    rows = documents.select(key, *names, body) if "text" not in names else documents.select(
        key, *[F.col(c).alias("original_text") if c == "text" else F.col(c) for c in names], body)
    return cut_out(rows.join(spans, "key", "left").drop("key"), size, anchor, as_is)


def substring_query(spark, sf_dir: str) -> DataFrame:
    """op2: 35-word windows that start twice or more are removed."""
    from ledgerscope.sources.tables import read_table
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT rid, k, hash(array_to_string(ws[k:k + 34], ' ')) AS h, md5(array_to_string(ws[k:k + 34], ' ')) AS m
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS k FROM d WHERE len(ws) >= 35)),
rep AS (SELECT h, m FROM win GROUP BY h, m HAVING count(*) > 1),
hit AS (SELECT DISTINCT rid, unnest(range(k, k + 35)) AS p FROM win JOIN rep USING (h, m)),
w AS (SELECT rid, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (
  SELECT w.rid, string_agg(w.word, ' ' ORDER BY w.p) AS t, count(*) AS n
  FROM w LEFT JOIN hit ON w.rid = hit.rid AND w.p = hit.p WHERE hit.p IS NULL GROUP BY w.rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
