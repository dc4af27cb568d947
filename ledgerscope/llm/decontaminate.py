"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The benchmark windows are the patterns. A document is read through a shift
table over blocks of two words: a block that no window holds lets the search
jump almost a whole window ahead. Where the shift is zero, the hash of the
window's last block together with its first block selects the test windows
of a bucket, and a comparison of the words themselves confirms each hit.

The benchmark is a stated query set. It is broadcast in blocks of at most
``block_words`` words, and documents pass through one search per block; the
documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.store import share
from ledgerscope.llm.textarrays import U64, WordHasher, mix, symbol_separators, text_slices

SHIFT_BITS = 18
LANE = 96
SLICE_BYTES = 1 << 20
# about 150 bytes a word while a block is built, 65 in the broadcast
BLOCK_WORDS = 1_000_000
LOWER = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of one text."""
    return text.encode("utf-8").translate(LOWER).split() if text else []


def block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring words."""
    return mix(a * U64(0xC2B2AE3D27D4EB4F) + b)


class ItemWords:
    """The words of all items of a block, one after another: bytes, bounds and hashes."""

    def __init__(self, texts: list[str | None], hasher: WordHasher):
        raw = [t.encode("utf-8").translate(LOWER) if t else b"" for t in texts]
        data = np.frombuffer(b" ".join(raw), np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        off = np.append(0, np.cumsum(size + 1))
        off[-1] = len(data)
        self.data = data
        self.h, self.item, self.start, self.end = hasher.words(data, off)

    def text(self, first: int, size: int) -> bytes:
        """The words from ``first`` on, joined by one space."""
        return b" ".join(self.data[self.start[first]:self.end[first + size - 1]].tobytes().split())


class WindowTable:
    """Shift table and buckets for the windows of one length, kept as positions into the items' words."""

    def __init__(self, size: int, words: ItemWords, at: np.ndarray, hasher: WordHasher):
        self.size, self.words = size, words
        mask = U64((1 << SHIFT_BITS) - 1)
        if size == 1:
            first = last = words.h[at]
            self.shift = np.ones(1 << SHIFT_BITS, np.uint8)
            self.shift[(mix(last) & mask).astype(np.int64)] = 0
        else:
            pair = block_hash(words.h[:-1], words.h[1:])
            self.shift = np.full(1 << SHIFT_BITS, min(size - 1, 255), np.uint8)
            for j in range(size - 1):
                np.minimum.at(self.shift, (pair[at + j] & mask).astype(np.int64), min(size - 2 - j, 255))
            first, last = pair[at], pair[at + size - 2]
        keys = mix(first ^ (last * U64(3)))
        whole = hasher.window_hash(words.h, size)[at]
        order = np.lexsort((whole, keys))
        at, keys, whole = at[order], keys[order], whole[order]
        # equal windows are one pattern with several items; what only hashes alike stays apart
        new = np.ones(len(at), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])
        lead = 0
        for k in np.flatnonzero(~new | np.append(~new[1:], False)).tolist():
            if new[k]:
                lead = k
            elif words.text(int(at[k]), size) != words.text(int(at[lead]), size):
                new[k], lead = True, k
        self.at, self.keys = at[new], keys[new]
        self.owner, self.owners_from = words.item[at], np.append(np.flatnonzero(new), len(at))

    def text(self, which: int) -> bytes:
        return self.words.text(int(self.at[which]), self.size)

    def items(self, which: int) -> list[int]:
        return self.owner[self.owners_from[which]:self.owners_from[which + 1]].tolist()

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Last-word positions whose shift is zero, found by jumping along lanes."""
        n, size = len(h), self.size
        if n < size:
            return np.zeros(0, np.int64)
        mask = U64((1 << SHIFT_BITS) - 1)
        at = np.arange(size - 1, n, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            block = mix(h[at]) if size == 1 else block_hash(h[at - 1], h[at])
            s = self.shift[(block & mask).astype(np.int64)]
            zero = s == 0
            found.append(at[zero])
            at = at + np.maximum(s, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found))

    def matches(self, h: np.ndarray, row: np.ndarray):
        """(first word position, window number) of hash-equal windows inside one row."""
        end = self.candidates(h)
        start = end - self.size + 1
        inside = row[start] == row[end]
        start, end = start[inside], end[inside]
        if self.size == 1:
            first = last = h[start]
        else:
            first, last = block_hash(h[start], h[start + 1]), block_hash(h[end - 1], h[end])
        keys = mix(first ^ (last * U64(3)))
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        width = hi - lo
        pick = np.repeat(np.arange(len(start)), width)
        which = np.arange(len(pick)) - np.repeat(np.cumsum(width) - width, width) + lo[pick]
        at = start[pick]
        same = np.ones(len(at), bool)
        for j in range(self.size):
            same &= h[at + j] == self.words.h[self.at[which] + j]
        return at[same], which[same]


class Patterns:
    """All windows of one benchmark block; each item is hashed once."""

    def __init__(self, rows: list[tuple[str, str | None]], n: int):
        hasher = WordHasher(symbol_separators(), lower=True)
        self.ids = sorted({i for i, _ in rows})
        number = {i: k for k, i in enumerate(self.ids)}
        words = ItemWords([t for _, t in rows], hasher)
        count = np.bincount(words.item, minlength=len(rows))
        row = words.item
        words.item = np.array([number[i] for i, _ in rows], np.int64)[row]
        base = np.cumsum(count) - count
        size = np.minimum(count, n)[row]
        place = np.arange(len(row)) - base[row]
        starts = place + size <= count[row]
        self.tables = [WindowTable(int(s), words, np.flatnonzero(starts & (size == s)), hasher) for s in np.unique(size).tolist()]


def search(patterns: Patterns, column: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Per row: number of words, merged hit ranges (in words), item ids."""
    hasher = WordHasher(symbol_separators(), lower=True)
    counts, ranges, items = [], [], []
    for _, rows, data, off in text_slices(column, SLICE_BYTES):
        h, row, start, end = hasher.words(data, off)
        counts.extend(np.bincount(row, minlength=rows).tolist())
        base = np.searchsorted(row, np.arange(rows))
        hits: dict[int, tuple[list, set]] = {}
        for t in patterns.tables:
            for at, which in zip(*(x.tolist() for x in t.matches(h, row))):
                s, e = int(start[at]), int(end[at + t.size - 1])
                if b" ".join(data[s:e].tobytes().translate(LOWER).split()) != t.text(which):
                    continue
                r = int(row[at])
                spans, owners = hits.setdefault(r, ([], set()))
                spans.append((at - int(base[r]), at - int(base[r]) + t.size))
                owners.update(t.items(which))
        for r in range(rows):
            if r not in hits:
                ranges.append([])
                items.append([])
                continue
            spans, owners = hits[r]
            merged: list[tuple[int, int]] = []
            for s, e in sorted(spans):
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            ranges.append(merged)
            items.append([patterns.ids[k] for k in sorted(owners)])
    return counts, ranges, items


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's rows, some at a time, at most ``block_words`` words (or one item) together."""
    rows: list[tuple[str, str | None]] = []
    total = 0
    ids = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    for r in benchmark.select(ids.alias("i"), F.col("text").alias("t")).toLocalIterator():
        n = len(words_of(r.t))
        if rows and total + n > block_words:
            yield rows
            rows, total = [], 0
        rows.append((r.i, r.t))
        total += n
    yield rows


def find_contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10,
                       block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Hit ranges and items per document row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
    lower-cased; an item's windows are its runs of ``n`` words, or all its
    words if it has fewer. Returns one row per input row: doc_id, the
    columns named in ``keep``, n_words, hits (array of word ranges
    [start, stop), merged) and items (ids with an occurring window, as
    strings). Defined cases: a null or empty text has no words and no hits;
    an item without words has no window; a null item id counts as the empty
    string; items that share a window all count; repeated rows and rows
    that share a doc_id are judged one by one; an empty benchmark hits
    nothing. Other columns of the inputs are ignored, whatever their names.
    """
    spark = documents.sparkSession
    hit_type = "array<struct<start:bigint,stop:bigint>>"
    out = documents.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])
    out = out.withColumns({"n_words": F.lit(0).cast("bigint"), "hits": F.array().cast(hit_type),
                           "items": F.array().cast("array<string>")})
    blocks = benchmark_blocks(benchmark, block_words)
    rows = next(blocks)
    while rows is not None:
        shared = share(spark, Patterns(rows, n))
        rows = next(blocks, None)
        drop_text = rows is None and "text" not in keep

        def scan(batches, shared=shared, drop_text=drop_text):
            patterns = shared()
            for b in batches:
                counts, ranges, items = search(patterns, b.column("text"))
                old_hits, old_items = b.column("hits").to_pylist(), b.column("items").to_pylist()
                for k in range(len(counts)):
                    if old_items[k]:
                        items[k] = sorted(set(items[k]) | set(old_items[k]))
                        joined = sorted(ranges[k] + [(x["start"], x["stop"]) for x in old_hits[k]])
                        ranges[k] = joined
                cols = {name: b.column(name) for name in b.schema.names if not (drop_text and name == "text")}
                cols["n_words"] = pa.array(counts, pa.int64())
                cols["hits"] = pa.array([[{"start": s, "stop": e} for s, e in r] for r in ranges],
                                        pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                cols["items"] = pa.array(items, pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(cols)

        out = out.mapInArrow(scan, out.drop("text").schema if drop_text else out.schema)
    return out


def hit_words(hits: str = "hits"):
    """Number of distinct words inside the ranges (ranges of several blocks may overlap)."""
    step = F.aggregate(
        F.array_sort(F.col(hits)),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("bigint"), x["stop"] - F.greatest(x["start"], acc["at"]))).alias("n"),
            F.greatest(acc["at"], x["stop"]).alias("at")),
        lambda acc: acc["n"])
    return step


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``documents`` without any occurring benchmark window, with all their columns."""
    # the row travels packed, so no column of it can clash with a result
    row = "__row"
    while row in documents.columns:
        row += "_"
    packed = documents.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias(row))
    found = find_contamination(packed, benchmark, n, keep=("text", row))
    return found.where(F.size("items") == 0).select(
        *[F.col("text") if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in documents.columns])


def contamination_query(spark, sf_dir: str) -> DataFrame:
    """op1: counts and item digest per document."""
    from ledgerscope.sources.tables import read_table
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(ws)) AS sz,
         array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT sz FROM bw),
dw AS (
  SELECT rid, sz, k, array_to_string(ws[k:k + sz - 1], ' ') AS win
  FROM (SELECT rid, ws, sz, unnest(range(1, len(ws) - sz + 2)) AS k FROM d, sizes WHERE len(ws) >= sz)),
m AS (SELECT dw.rid, dw.k, dw.sz, bw.item FROM dw JOIN bw ON dw.sz = bw.sz AND dw.win = bw.win),
h AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(k, k + sz)) AS p FROM m) GROUP BY rid),
i AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""
