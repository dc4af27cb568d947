"""Phrase collocations counted in quotient filters.

Words that occur often enough get ids without gaps; an n-gram of two to four ids
is one packed key. A Feistel network, which can be undone, spreads the keys evenly; the
top bits of the result are the shard and the quotient, all other bits the
remainder. A filter keeps, in sorted order, the run length of each quotient
(one bit per key and per quotient), the full remainders and counters of one byte
with an exact overflow. Nothing is lost: a filter gives back every key and count.

A task counts its own n-grams and writes one filter per shard; the filters of
a shard are merged as they stream in. Keys are even whatever the words, so a
very frequent phrase costs one key per task and no shard runs hot.

Counts are taken in two passes, pairs first. Longer n-grams are counted only
where every pair in them is frequent, read from a bitmap of hashed pairs: a
false hit there costs a needless count and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgerscope.llm.store import share, write_table
from ledgerscope.llm.textarrays import U64, WHITE_SPACE, chained_hash, mix, text_slices

LEAST = 30
LONGEST = 4
COVER = 80
SCALE = 2_000_000
TOP = 2000
SLICE_BYTES = 1 << 20
KEYS_HELD = 1 << 20        # distinct n-grams of a task before they are sent on
RAW_KEYS = 1 << 18         # n-grams met before they are sorted and merged
SHARD_KEYS = 1 << 19       # n-grams met per shard, which bounds its distinct keys
VOCABULARY_BLOCK = 1 << 20  # words broadcast at once; further blocks take further passes
BITMAP_BITS = 27           # at most; fewer where there are few pairs
ROUND_KEYS = tuple(U64(k) for k in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))
# fixed values: what ends a piece
PIECE_ENDS = (*b".,;:!?", 10, 11, 12, 13)


# ---------------------------------------------------------------- words

class Pieces:
    """Words of byte slices, lower-cased, with the breaks between pieces."""

    def __init__(self):
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[0x41:0x5B] += 32
        self.solid = np.ones(256, bool)
        self.solid[[*PIECE_ENDS, *WHITE_SPACE]] = False
        self.ends = np.zeros(256, bool)
        self.ends[list(PIECE_ENDS)] = True

    def read(self, data: np.ndarray, off: np.ndarray):
        """(bytes in lower case; start, stop and row of each word; whether a piece begins there)."""
        data = self.lower[data]
        solid = self.solid[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        stop = np.flatnonzero(solid & (~after | edge[1:])) + 1
        if not len(start):
            return data, start, start, start, start.astype(bool)
        row = np.searchsorted(off, start, side="right") - 1
        ended = np.append(0, np.cumsum(self.ends[data]))
        new = np.ones(len(start), bool)
        new[1:] = (row[1:] != row[:-1]) | (ended[start[1:]] != ended[start[:-1]])
        return data, start, stop, row, new


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n) summed per task; ``documents`` has lang and text."""

    def run(batches):
        pieces = Pieces()
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            lang_of = langs.indices.to_numpy()
            for first, _, data, off in text_slices(b.column("text"), SLICE_BYTES):
                data, start, stop, row, _ = pieces.read(data, off)
                if not len(start):
                    continue
                # words and the gaps between them are one binary array over the same bytes
                cuts = np.empty(2 * len(start), np.int64)
                cuts[0::2], cuts[1::2] = start, stop
                parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                coded = parts.dictionary_encode()
                size = len(coded.dictionary)
                key, times = np.unique(lang_of[first + row].astype(np.int64) * size + coded.indices.to_numpy()[::2], return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": langs.dictionary.take(pa.array(key // size)).cast(pa.string()),
                    "word": coded.dictionary.take(pa.array(key % size)).cast(pa.large_string()).cast(pa.string()), "n": pa.array(times)})

    return documents.select("lang", "text").mapInArrow(run, "lang string, word string, n bigint")


def digests(langs: list[str], lang_of: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Two independent 64-bit hashes of each word with its language."""
    seeds = np.array([[xxhash.xxh3_64_intdigest(g.encode(), seed=s) for g in langs] for s in (1, 2)], U64).reshape(2, -1)
    return tuple(chained_hash(data, start, stop, seeds[k][lang_of]) for k in range(2))


def vocabulary(counts: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id, hi, lo) of the frequent words: ids from 1 without gaps, and the words' digests.

    Ids run through hash buckets: a row number inside the bucket, and the
    sizes of the buckets before it (a list of fixed length).
    """
    words = counts.where(F.col("f") >= least).withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(1024)).cast("int"))
    words = write_table(words.select("lang", "word", "f", "bucket"), "frequent-words")
    sizes = words.groupBy("bucket").count()
    before = sizes.select("bucket", F.coalesce(F.sum("count").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    numbered = words.withColumn("place", place).join(F.broadcast(before), "bucket").select(
        "lang", "word", "f", (F.col("before") + F.col("place")).alias("id"))

    def run(batches):
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            for first, n, data, off in text_slices(b.column("word"), SLICE_BYTES):
                hi, lo = digests(langs.dictionary.to_pylist(), langs.indices.to_numpy()[first:first + n], data, off[:-1], off[1:])
                yield pa.RecordBatch.from_pydict({c: b.column(c).slice(first, n) for c in ("lang", "word", "f", "id")} | {
                    "hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64))})

    return write_table(numbered.mapInArrow(run, "lang string, word string, f bigint, id bigint, hi bigint, lo bigint"), "vocabulary")


class Block:
    """Ids of a bounded part of the vocabulary, found by the words' two hashes."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, ids: np.ndarray):
        order = np.lexsort((lo, hi))
        self.hi, self.lo, self.ids = hi[order], lo[order], ids[order]
        self.bits = max(len(hi).bit_length(), 1)
        self.first = np.searchsorted(self.hi >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64))

    @classmethod
    def of(cls, words: DataFrame, first: int, size: int) -> "Block":
        got = words.where((F.col("id") >= first) & (F.col("id") < first + size)).select("hi", "lo", "id").toArrow()
        hi, lo, ids = (got.column(c).to_numpy() for c in ("hi", "lo", "id"))
        return cls(hi.view(U64), lo.view(U64), ids)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Ids by hash; 0 for words of other blocks or of none."""
        out = np.zeros(len(hi), np.int64)
        slot = (hi >> U64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        todo = np.flatnonzero(at < stop)
        step = 0
        while len(todo):
            here = at[todo] + step
            same = (self.hi[here] == hi[todo]) & (self.lo[here] == lo[todo])
            out[todo[same]] = self.ids[here[same]]
            todo = todo[~same & (here + 1 < stop[todo])]
            step += 1
        return out


def slice_ids(pieces: Pieces, block: Block, langs: list[str], lang_of, data, off):
    """(id of each word, 0 for rare ones; row; whether a piece begins there)."""
    data, start, stop, row, new = pieces.read(data, off)
    if not len(start):
        return np.zeros(0, np.int64), row, new
    return block.find(*digests(langs, lang_of[row], data, start, stop)), row, new


def with_block(rows: DataFrame, block: Block) -> DataFrame:
    """``rows`` (lang, text, ids) with the ids that this block adds; a null list starts as zeros."""
    shared = share(rows.sparkSession, block)

    def run(batches):
        pieces, known = Pieces(), shared()
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            names, lang_of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for first, n, data, off in text_slices(b.column("text"), SLICE_BYTES):
                ids, row, _ = slice_ids(pieces, known, names, lang_of[first:first + n], data, off)
                old = b.column("ids").slice(first, n)
                if old.null_count == 0:
                    ids = np.maximum(ids, old.flatten().to_numpy())
                upto = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "lang": b.column("lang").slice(first, n), "text": b.column("text").slice(first, n),
                    "ids": pa.ListArray.from_arrays(pa.array(upto), pa.array(ids, pa.int64()))})

    return rows.mapInArrow(run, "lang string, text string, ids array<bigint>")


# ---------------------------------------------------------------- keys and filters

def permute(left: np.ndarray, right: np.ndarray, half: int):
    """Spread packed keys of two halves of ``half`` bits over all keys, one to one."""
    mask = U64((1 << half) - 1)
    for k in ROUND_KEYS:
        left, right = right, left ^ (mix(right + k) & mask)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, half: int):
    """Undo ``permute``."""
    mask = U64((1 << half) - 1)
    for k in reversed(ROUND_KEYS):
        left, right = right ^ (mix(left + k) & mask), left
    return left, right


def aligned(left: np.ndarray, right: np.ndarray, half: int):
    """A key of 2 * ``half`` bits as its top 64 bits and the rest (0 where all fit)."""
    if 2 * half <= 64:
        return (left << U64(half) | right) << U64(64 - 2 * half), None
    over = 2 * half - 64
    return left << U64(64 - half) | right >> U64(over), right & U64((1 << over) - 1)


def halves(hi: np.ndarray, lo: np.ndarray | None, half: int):
    """Undo ``aligned``."""
    if lo is None:
        whole = hi >> U64(64 - 2 * half)
        return whole >> U64(half), whole & U64((1 << half) - 1)
    over = 2 * half - 64
    return hi >> U64(64 - half), (hi << U64(over) | lo) & U64((1 << half) - 1)


def summed(hi: np.ndarray, lo: np.ndarray | None, n: np.ndarray):
    """Sorted distinct keys with their sums; the parts given are sorted runs, which a stable sort merges."""
    if not len(hi):
        return hi, lo, n
    order = np.argsort(hi, kind="stable") if lo is None else np.lexsort((lo, hi))
    hi, n = hi[order], n[order]
    new = np.ones(len(hi), bool)
    new[1:] = hi[1:] != hi[:-1]
    if lo is not None:
        lo = lo[order]
        new[1:] |= lo[1:] != lo[:-1]
    first = np.flatnonzero(new)
    return hi[first], None if lo is None else lo[first], np.add.reduceat(n, first)


class Counts:
    """Sorted distinct keys with exact counts; what is new is merged in once there is enough of it."""

    def __init__(self, wide: bool):
        none = np.zeros(0, U64)
        self.hi, self.lo, self.n = none, none if wide else None, np.zeros(0, np.int64)
        self.parts, self.waiting = [], 0

    def add(self, hi, lo, n) -> None:
        """Add keys with counts (sorted), or single keys as they were met (n is None)."""
        self.parts.append((hi, lo, n))
        self.waiting += len(hi)
        if self.waiting > max(len(self.hi) // 2, RAW_KEYS):
            self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        raw = [p for p in self.parts if p[2] is None]
        runs = [(self.hi, self.lo, self.n), *[p for p in self.parts if p[2] is not None]]
        self.parts, self.waiting = [], 0
        if raw:
            hi = np.concatenate([p[0] for p in raw])
            if self.lo is None:
                hi.sort()
                first = np.flatnonzero(np.append(True, hi[1:] != hi[:-1])) if len(hi) else np.zeros(0, np.int64)
                runs.append((hi[first], None, np.diff(np.append(first, len(hi)))))
            else:
                runs.append(summed(hi, np.concatenate([p[1] for p in raw]), np.ones(len(hi), np.int64)))
        lo = None if self.lo is None else np.concatenate([p[1] for p in runs])
        self.hi, self.lo, self.n = summed(np.concatenate([p[0] for p in runs]), lo, np.concatenate([p[2] for p in runs]))


def packed_bytes(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each value in whole bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8]).tobytes()


def unpacked_bytes(raw: bytes, n: int, bits: int) -> np.ndarray:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(U64)


def pack_filter(hi, lo, n, shard_bits: int, half: int) -> dict:
    """Filter of sorted distinct keys of one shard: quotient runs, remainders, counters and their overflow."""
    top = min(64, 2 * half)
    q = min(max(len(hi), 1).bit_length() - 1, top - shard_bits)
    inside = hi << U64(shard_bits) if shard_bits else hi
    quotient = (inside >> U64(64 - q)).astype(np.int64) if q else np.zeros(len(hi), np.int64)
    # each quotient closes with a 1 after a 0 for each of its keys
    runs = np.zeros(len(hi) + (1 << q), np.uint8)
    runs[np.arange(1 << q) + np.cumsum(np.bincount(quotient, minlength=1 << q))] = 1
    bits = top - shard_bits - q
    rest = (inside << U64(q)) >> U64(64 - bits) if bits else np.zeros(len(hi), U64)
    remainder = packed_bytes(rest, bits) + (packed_bytes(lo, 2 * half - 64) if lo is not None else b"")
    big = n >= 255
    return {"m": len(hi), "q": q, "runs": np.packbits(runs).tobytes(), "remainder": remainder,
            "counter": np.where(big, 255, n).astype(np.uint8).tobytes(), "overflow": n[big].astype("<i8").tobytes()}


def unpack_filter(part: dict, shard: int, shard_bits: int, half: int):
    """The sorted keys and counts that ``pack_filter`` was given."""
    m, q = part["m"], part["q"]
    top = min(64, 2 * half)
    bits = top - shard_bits - q
    runs = np.unpackbits(np.frombuffer(part["runs"], np.uint8), count=m + (1 << q))
    quotient = np.cumsum(runs)[runs == 0].astype(U64)
    width = m * ((bits + 7) // 8)
    hi = unpacked_bytes(part["remainder"][:width], m, bits) << U64(64 - top) if bits else np.zeros(m, U64)
    if q:
        hi |= quotient << U64(64 - shard_bits - q)
    if shard_bits:
        hi |= U64(shard) << U64(64 - shard_bits)
    lo = unpacked_bytes(part["remainder"][width:], m, 2 * half - 64) if 2 * half > 64 else None
    n = np.frombuffer(part["counter"], np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(part["overflow"], "<i8")
    return hi, lo, n


class Bitmap:
    """Membership of hashed pairs without misses; other pairs may be taken for members."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def place(left: np.ndarray, bits: int) -> np.ndarray:
        return mix(left + U64(0x452821E638D01377)) >> U64(64 - bits)

    def has(self, left: np.ndarray) -> np.ndarray:
        at = self.place(left, self.bits)
        return (self.words[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool)


def ngram_keys(ids: np.ndarray, new: np.ndarray, bits: int, lengths: tuple[int, ...], pairs: Bitmap | None):
    """Packed halves of all n-grams of frequent words inside pieces."""
    if len(ids) < 2:
        return np.zeros(0, U64), np.zeros(0, U64)
    w = ids.astype(U64)
    two = w[:-1] << U64(bits) | w[1:]
    ok = (ids[:-1] > 0) & (ids[1:] > 0) & ~new[1:]
    if pairs is not None:
        at = np.flatnonzero(ok)
        ok[at] = pairs.has(two[at])
    left, right = [], []
    run = ok
    for n in range(2, max(lengths) + 1):
        if n > 2:
            run = run[:-1] & ok[n - 2:]
        if n in lengths:
            at = np.flatnonzero(run)
            left.append(two[at])
            right.append(np.zeros(len(at), U64) if n == 2 else w[at + 2] << U64(bits) if n == 3 else two[at + 2])
    return np.concatenate(left), np.concatenate(right)


def shard_filters(documents: DataFrame, block: Block | None, bits: int, lengths: tuple[int, ...], shard_bits: int,
                  pairs: Bitmap | None) -> DataFrame:
    """One row per task and shard: the filter of its n-grams. ``documents`` has lang and text, and ids if no block is given."""
    shared = share(documents.sparkSession, (block, pairs))
    half = 2 * bits

    def run(batches):
        pieces, (known, members) = Pieces(), shared()
        counts = Counts(2 * half > 64)

        def flush():
            counts.settle()
            cuts = np.searchsorted(counts.hi, np.arange(1 << shard_bits, dtype=U64) << U64(64 - shard_bits)) if shard_bits else np.zeros(1, np.int64)
            ends = np.append(cuts[1:], len(counts.hi))
            for low in range(0, 1 << shard_bits, 256):
                rows = [(k, pack_filter(counts.hi[s:e], None if counts.lo is None else counts.lo[s:e], counts.n[s:e], shard_bits, half))
                        for k, s, e in zip(range(low, low + 256), cuts[low:low + 256].tolist(), ends[low:low + 256].tolist()) if e > s]
                if rows:
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([k for k, _ in rows], pa.int32()), "m": pa.array([f["m"] for _, f in rows], pa.int32()),
                        "q": pa.array([f["q"] for _, f in rows], pa.int32()),
                        **{c: pa.array([f[c] for _, f in rows], pa.binary()) for c in ("runs", "remainder", "counter", "overflow")}})
            counts.__init__(2 * half > 64)

        for b in batches:
            if known is not None:
                langs = b.column("lang").dictionary_encode()
                names, lang_of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for first, n, data, off in text_slices(b.column("text"), SLICE_BYTES):
                if known is not None:
                    ids, _, new = slice_ids(pieces, known, names, lang_of[first:first + n], data, off)
                else:
                    new = pieces.read(data, off)[4]
                    ids = b.column("ids").slice(first, n).flatten().to_numpy()
                left, right = ngram_keys(ids, new, bits, lengths, members)
                for at in range(0, len(left), 1 << 17):
                    hi, lo = aligned(*permute(left[at:at + (1 << 17)], right[at:at + (1 << 17)], half), half)
                    counts.add(hi, lo, None)
                if len(counts.hi) >= KEYS_HELD:
                    yield from flush()
        counts.settle()
        if len(counts.hi):
            yield from flush()

    return documents.mapInArrow(run, "shard int, m int, q int, runs binary, remainder binary, counter binary, overflow binary")


def merged_filters(filters: DataFrame, bits: int, shard_bits: int, least: int) -> DataFrame:
    """(w1, w2, w3, w4, f) of n-grams met at least ``least`` times; ids of absent words are 0."""
    half = 2 * bits

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        counts = Counts(2 * half > 64)
        for b in batches:
            for k in range(b.num_rows):
                part = {c: b.column(c)[k].as_py() for c in ("m", "q", "runs", "remainder", "counter", "overflow")}
                counts.add(*unpack_filter(part, shard, shard_bits, half))
        counts.settle()
        often = counts.n >= least
        left, right = restore(*halves(counts.hi[often], None if counts.lo is None else counts.lo[often], half), half)
        low, mask = U64(bits), U64((1 << bits) - 1)
        cols = {"w1": left >> low, "w2": left & mask, "w3": right >> low, "w4": right & mask}
        yield pa.RecordBatch.from_pydict({c: pa.array(v.astype(np.int64)) for c, v in cols.items()} | {"f": pa.array(counts.n[often])})

    return filters.groupBy("shard").applyInArrow(run, "w1 bigint, w2 bigint, w3 bigint, w4 bigint, f bigint")


def pair_bitmap(pairs: DataFrame, bits: int) -> Bitmap | None:
    """Bitmap of the frequent pairs, of at most ``BITMAP_BITS``; None if there are none."""
    n = pairs.count()
    if not n:
        return None
    size = min(max((16 * n).bit_length(), 10), BITMAP_BITS)

    def run(batches):
        for b in batches:
            left = b.column("w1").to_numpy().astype(U64) << U64(bits) | b.column("w2").to_numpy().astype(U64)
            at = Bitmap.place(left, size)
            word, back = np.unique(at >> U64(6), return_inverse=True)
            out = np.zeros(len(word), U64)
            np.bitwise_or.at(out, back, U64(1) << (at & U64(63)))
            yield pa.RecordBatch.from_pydict({"word": pa.array(word.astype(np.int64)), "v": pa.array(out.view(np.int64))})

    got = pairs.select("w1", "w2").mapInArrow(run, "word bigint, v bigint").groupBy("word").agg(F.bit_or("v").alias("v")).toArrow()
    words = np.zeros(1 << (size - 6), np.int64)
    words[got.column("word").to_numpy()] = got.column("v").to_numpy()
    return Bitmap(size, words.view(U64))


# ---------------------------------------------------------------- phrases

def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, sizes): frequent phrases by word ids with f; the vocabulary; n per lang.

    Defined cases: a null text is empty, a null lang counts as ``und``; rows
    that repeat are counted each; other columns are ignored; an empty table
    gives empty results.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases have 2 to 4 words")
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = write_table(word_counts(docs).groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = vocabulary(counts, least)
    v, met = words.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    bits = max(int(v).bit_length(), 1)
    if bits > 31:
        raise ValueError("more than two thousand million frequent words")
    block = None
    if v <= VOCABULARY_BLOCK:
        block = Block.of(words, 1, VOCABULARY_BLOCK)
    else:
        docs = docs.withColumn("ids", F.lit(None).cast("array<bigint>"))
        for first in range(1, v + 1, VOCABULARY_BLOCK):
            docs = write_table(with_block(docs, Block.of(words, first, VOCABULARY_BLOCK)), "word-ids")
    shard_bits = min(max(int(met * 2 // SHARD_KEYS).bit_length(), 3), 4 * bits - 1)
    pairs = write_table(merged_filters(shard_filters(docs, block, bits, (2,), shard_bits, None), bits, shard_bits, least), "pairs")
    phrases = pairs
    if longest > 2:
        members = pair_bitmap(pairs, bits)
        if members is not None:
            more = shard_filters(docs, block, bits, tuple(range(3, longest + 1)), shard_bits, members)
            phrases = pairs.union(write_table(merged_filters(more, bits, shard_bits, least), "longer"))
    return phrases, words, sizes


def id_at(k: int):
    return F.col(f"w{k}")


def ids_of(first: int, last: int, prefix: str = "w"):
    """Columns of the phrase made of words ``first`` to ``last``, zeros behind."""
    cols = [id_at(k) for k in range(first, last + 1)] + [F.lit(0).cast("bigint")] * (4 - (last - first + 1))
    return [c.alias(f"{prefix}{k}") for k, c in enumerate(cols, 1)]


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each lang.

    A phrase's score is that of its worst cut; phrases that a longer one covers to
    ``cover`` percent are left out. See ``frequent_phrases`` for defined cases.
    """
    phrases, words, sizes = frequent_phrases(documents, least, longest)
    size = F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)
    phrases = phrases.withColumn("size", size)
    names = ["w1", "w2", "w3", "w4"]
    zero = F.lit(0).cast("bigint")
    known = words.select(F.col("id").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), "f").union(
        phrases.where("size < 4").select(*names, "f"))

    def spans(lengths):
        """Contiguous parts as (size of the phrase, first, last)."""
        return [(n, i, i + k - 1) for n in (3, 4) for k in range(2, n) for i in range(1, n - k + 2) if n in lengths]

    inner = F.filter(F.array(*[F.when(F.col("size") == n, F.struct(*ids_of(i, j))) for n, i, j in spans((3, 4))]),
                     lambda x: x.isNotNull())
    covered = phrases.where("size > 2").select("f", F.explode(inner).alias("p")).groupBy(
        *[F.col(f"p.{c}").alias(c) for c in names]).agg(F.max("f").alias("longer"))
    kept = phrases.join(covered, names, "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * cover)) \
        .select(*names, "size", F.col("f").alias("a"))
    cuts = F.filter(F.array(*[
        F.when(F.col("size") == n, F.struct(F.lit(k).alias("k"), *ids_of(1, k, "l"), *ids_of(k + 1, n, "r")))
        for n in (2, 3, 4) for k in range(1, n)]), lambda x: x.isNotNull())
    rows = kept.select(*names, "a", F.explode(cuts).alias("c")).select(*names, "a", "c.*")
    side = {s: known.select(*[F.col(c).alias(f"{s}{c[1]}") for c in names], F.col("f").alias(s)) for s in "lr"}
    rows = rows.join(side["l"], ["l1", "l2", "l3", "l4"]).join(side["r"], ["r1", "r2", "r3", "r4"])
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(20,0)) * CAST(a AS DECIMAL(18,0)) DIV CAST(l + r AS DECIMAL(20,0)) AS BIGINT)")
    worst = rows.withColumn("score", score).groupBy(*names, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    spelled = worst.select(*names, "a", "m.score", "m.l", "m.r")
    for k, c in enumerate(names):
        spell = words.select(F.col("id").alias(c), F.col("word").alias(f"word{k}"), *(["lang"] if k == 0 else []))
        spelled = spelled.join(spell, c, "inner" if k < 2 else "left")
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", *[f"word{k}" for k in range(4)]))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocation_query(spark, sf_dir: str) -> DataFrame:
    """op12: the first 2,000 phrases of each language."""
    from ledgerscope.sources.tables import read_table
    return collocations(read_table(spark, sf_dir, "documents"))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS rid, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^.,;:!?\x0A-\x0D]+')) AS piece
    FROM documents)),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= 30),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, size - k + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS k) WHERE k < size) GROUP BY ALL),
kept AS (
  SELECT c.* FROM cand c LEFT JOIN inner_parts p USING (lang, phrase) WHERE p.longer IS NULL OR 100 * p.longer < 80 * c.a),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
