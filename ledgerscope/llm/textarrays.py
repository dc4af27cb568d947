"""Words of Arrow text columns as numpy arrays.

A text column arrives in a task as one byte buffer with offsets. Words are
found and hashed on that buffer with array operations, so no Python object
is made per word. All hashes are fixed functions of the bytes: they agree
between tasks, retries and machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
WHITE_SPACE = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def white_space_separators() -> np.ndarray:
    """Separators of the word class ``[^\\x20\\x09-\\x0D]+``."""
    sep = np.zeros(256, bool)
    sep[list(WHITE_SPACE)] = True
    return sep


def symbol_separators() -> np.ndarray:
    """Separators of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    sep = np.ones(256, bool)
    sep[0x30:0x3A] = False
    sep[0x41:0x5B] = False
    sep[0x61:0x7B] = False
    sep[0x80:] = False
    return sep


def text_slices(column: pa.Array, max_bytes: int):
    """Yield (first row, row count, bytes, offsets) of consecutive rows.

    A slice holds at most ``max_bytes`` of text, or a single longer text.
    Null texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(off, off[row] + max_bytes, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield row, last - row, data[off[row]:off[last]], off[row:last + 1] - off[row]
        row = last


LONG_WORD = 256


def chained_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed) -> np.ndarray:
    """Hash of the bytes [start, end): eight at a time, each step mixes all bits so far.

    Unlike a polynomial modulo a power of two, no repetitive word collides by
    its structure. ``seed`` is one value or one per word. Words beyond
    ``LONG_WORD`` bytes are hashed whole.
    """
    size = end - start
    h = np.empty(len(start), U64)
    h[:] = mix((size.astype(U64) + U64(1)) * U64(WORD_BASE) ^ seed)
    if not len(start):
        return h
    room = np.zeros(len(data) + 8, np.uint8)
    room[:len(data)] = data
    lanes = np.ndarray((len(data) + 1,), np.dtype("<u8"), room, strides=(1,))
    short = size <= LONG_WORD
    todo = np.flatnonzero(short & (size > 0))
    done = 0
    while len(todo):
        left = size[todo] - done
        lane = lanes[start[todo] + done]
        part = left < 8
        lane[part] &= (U64(1) << (left[part] * 8).astype(U64)) - U64(1)
        h[todo] = mix((h[todo] ^ lane) * U64(BYTE_BASE) + U64(0x632BE59BD9B4E019))
        done += 8
        todo = todo[left > 8]
    for k in np.flatnonzero(~short).tolist():
        h[k] = xxhash.xxh3_64_intdigest(room[start[k]:end[k]].tobytes(), seed=int(h[k]))
    return h


class WordHasher:
    """Finds and hashes the words of byte slices; made once per task."""

    def __init__(self, separators: np.ndarray, lower: bool = False):
        table = mix(np.arange(1, 257, dtype=U64) * U64(BYTE_BASE)) | U64(1)
        if lower:
            table[0x41:0x5B] = table[0x61:0x7B]
        self.table = table
        self.lower = np.arange(256, dtype=np.uint8)
        if lower:
            self.lower[0x41:0x5B] += 32
        self.solid = ~separators
        self._pow = {}

    def powers(self, base: int, n: int) -> np.ndarray:
        """base**0 .. base**(n-1) modulo 2**64."""
        have = self._pow.get(base)
        if have is None or len(have) < n:
            size = max(n, 1 << 16) if have is None else max(n, 2 * len(have))
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            have = self._pow[base] = np.multiply.accumulate(steps)
        return have[:n]

    def bounds(self, data: np.ndarray, off: np.ndarray):
        """Start and end byte of each word, and the row it belongs to."""
        n = len(data)
        solid = self.solid[data]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        start = np.flatnonzero(solid & (~before | cut[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        end = np.flatnonzero(solid & (~after | cut[1:])) + 1
        row = np.searchsorted(off, start, side="right") - 1
        return start, end, row

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Running polynomial sums of the bytes; see ``span_hash``."""
        out = np.empty(len(data) + 1, U64)
        out[0] = 0
        np.cumsum(self.table[data] * self.powers(BYTE_BASE, len(data)), out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, end), whatever stands around them."""
        inverse = self.powers(pow(BYTE_BASE, -1, 1 << 64), len(prefix))
        return mix((prefix[end] - prefix[start]) * inverse[start])

    def words(self, data: np.ndarray, off: np.ndarray):
        """(hash, row, start, end) of every word of a slice."""
        start, end, row = self.bounds(data, off)
        if len(start) == 0:
            return np.zeros(0, U64), row, start, end
        return chained_hash(self.lower[data], start, end, U64(0)), row, start, end

    def window_hash(self, words: np.ndarray, size: int) -> np.ndarray:
        """Order-dependent hash of every run of ``size`` consecutive words."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, U64)
        total = np.empty(len(words) + 1, U64)
        total[0] = 0
        np.cumsum(words * self.powers(WORD_BASE, len(words)), out=total[1:])
        inverse = self.powers(pow(WORD_BASE, -1, 1 << 64), n)
        return mix((total[size:] - total[:n]) * inverse)

    def run_hash(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Order-dependent hash of the word runs [first, last)."""
        total = np.empty(len(words) + 1, U64)
        total[0] = 0
        np.cumsum(words * self.powers(WORD_BASE, len(words)), out=total[1:])
        inverse = self.powers(pow(WORD_BASE, -1, 1 << 64), len(words) + 1)
        return mix((total[last] - total[first]) * inverse[first])
