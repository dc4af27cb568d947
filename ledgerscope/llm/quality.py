"""Quality scores from random-indexing word vectors and a two-layer network.

Random indexing: every token has a sparse signed index vector given by its
hash; the vector of a token is the sum of the index vectors of its
neighbours over the whole corpus. Tokens share ``BUCKETS`` rows by hash, so the
table has a fixed size however large the corpus is; tasks add up their own
table first and send on one number per cell.

A document is the mean of its tokens' vectors, of their squares, and of the
products of neighbours. A two-layer network (numpy, Adam) scores it, and a
temperature fitted on documents that taught nothing calibrates the score.

The word vectors count all documents; the network learns from a bounded
sample (SAMPLE documents per class, by a hash of the id) outside the
held-out fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.labelled import fold, labelled_sample
from ledgerscope.llm.store import share, with_fields
from ledgerscope.llm.textarrays import U64, WordHasher, text_slices

BUCKETS = 4096
DIMS = 32
SAMPLE = {0: 2500, 1: 4000}
HIDDEN = 24
THRESHOLD = 0.3
SLICE_BYTES = 1 << 19


def token_separators() -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[:33] = True
    return sep


def byte_classes() -> np.ndarray:
    """Letters and digits 1, other signs 2, space 0: a token is a run of one class."""
    kind = np.full(256, 2, np.uint8)
    kind[:33] = 0
    kind[0x30:0x3A] = kind[0x41:0x5B] = kind[0x61:0x7B] = 1
    kind[0x80:] = 1
    return kind


class Tokens:
    """Token hashes of byte slices."""

    def __init__(self):
        self.hasher = WordHasher(token_separators())
        self.kind = byte_classes()

    def read(self, data: np.ndarray, off: np.ndarray):
        """(hash, row) of each token."""
        kind = self.kind[data]
        edge = np.ones(len(data) + 1, bool)
        if len(data):
            edge[1:-1] = kind[1:] != kind[:-1]
        edge[off] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        real = kind[start] > 0
        start, end = start[real], end[real]
        if not len(start):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        h = self.hasher.span_hash(self.hasher.prefix(data), start, end)
        return h, np.searchsorted(off, start, side="right") - 1


def index_of(h: np.ndarray):
    """Bucket and the two signed index dimensions of each token."""
    return ((h >> U64(20)) % U64(BUCKETS)).astype(np.int64), (h & U64(DIMS - 1)).astype(np.int64), \
        ((h >> U64(8)) & U64(DIMS - 1)).astype(np.int64)


def add_contexts(total: np.ndarray, h: np.ndarray, row: np.ndarray) -> None:
    """Add the index vectors of the neighbours (two on each side) to each token's row."""
    bucket, plus, minus = index_of(h)
    size = BUCKETS * DIMS
    for gap in (1, 2):
        same = np.flatnonzero(row[gap:] == row[:-gap])
        left, right = same, same + gap
        for own, other, turn in ((left, right, 0), (right, left, 1)):
            at = bucket[own] * DIMS
            total += np.bincount(at + (plus[other] + turn) % DIMS, minlength=size)
            total -= np.bincount(at + (minus[other] + turn) % DIMS, minlength=size)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The (BUCKETS, DIMS) table of context sums over all documents, centred and scaled."""

    def run(batches):
        tokens, total = Tokens(), np.zeros(BUCKETS * DIMS, np.int64)
        for b in batches:
            for _, _, data, off in text_slices(b.column("text"), SLICE_BYTES):
                add_contexts(total, *tokens.read(data, off))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell.astype(np.int32)), "v": pa.array(total[cell])})

    cells = documents.select("text").mapInArrow(run, "cell int, v bigint").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    table = np.zeros(BUCKETS * DIMS)
    table[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    table = table.reshape(BUCKETS, DIMS)
    table = np.sign(table) * np.log1p(np.abs(table))
    table -= table.mean(axis=0)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Features of each row: pooled token vectors, their squares, products of neighbours, log length."""
    tokens, out = Tokens(), []
    for _, rows, data, off in text_slices(column, SLICE_BYTES):
        h, row = tokens.read(data, off)
        part = np.zeros((rows, 3 * DIMS + 1))
        if len(h):
            v = table[index_of(h)[0]]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            own, count = row[first], np.diff(np.append(first, len(row)))[:, None]
            part[own, :DIMS] = np.add.reduceat(v, first) / count
            part[own, DIMS:2 * DIMS] = np.add.reduceat(v * v, first) / count
            product = np.zeros_like(v)
            product[:-1] = v[:-1] * v[1:]
            product[np.append(first[1:], len(row)) - 1] = 0
            part[own, 2 * DIMS:-1] = np.add.reduceat(product, first) / np.maximum(count - 1, 1)
            part[own, -1] = np.log1p(count[:, 0])
        out.append(part)
    return np.concatenate(out) if out else np.zeros((0, 3 * DIMS + 1))


class Network:
    """Two layers and a temperature; a constant where a class is missing."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5):
        self.constant = None
        if not len(y):
            self.constant = 0.0
            return
        if y.min() == y.max():
            self.constant = float(y[0])
            return
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.std
        rng = np.random.default_rng(seed)
        test = np.arange(len(y)) % 5 == 4
        if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
            test[:] = False
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        learn, step = np.flatnonzero(~test), 0
        for _ in range(40):
            for at in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
                a = np.tanh(x[at] @ self.p[0] + self.p[1])
                z = a @ self.p[2] + self.p[3]
                d = weight[at] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
                back = np.outer(d, self.p[2]) * (1 - a * a)
                grads = [x[at].T @ back + 1e-3 * self.p[0], back.sum(axis=0), a.T @ d + 1e-3 * self.p[2], np.array([d.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        if test.any():
            z = self.logits(x[test])
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [(weight[test] * np.logaddexp(0, np.where(y[test] > 0, -z, z) / t)).sum() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.logits((x - self.mean) / self.std) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn_quality(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network fitted outside the held-out fold."""
    learn = ~fold("doc_id", 5, 0)
    sample = labelled_sample(documents, labels, "quality", learn, SAMPLE)
    table = word_vectors(documents)
    x = pooled(pa.array([t for t, _ in sample], pa.large_string()), table)
    y = np.array([c for _, c in sample], float)
    share = {int(r.quality): r["count"] for r in labels.where(learn & F.col("quality").isin(0, 1)).groupBy("quality").count().collect()}
    weight = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weight[y == c] = share[c] / sum(share.values()) / (y == c).mean()
    order = np.random.default_rng(3).permutation(len(y))
    return table, Network(x[order], y[order], weight[order])


def score_quality(documents: DataFrame, model: tuple[np.ndarray, Network], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep`` and score (0 to 1, higher: label 1 likelier) of every row.

    Defined cases: null, empty and blank texts pool to zeros and are scored
    like any other; if the sample has one class only, that class is every
    score, and without any labels the score is 0; repeated rows are scored
    one by one; other columns are ignored.
    """
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    shared = share(documents.sparkSession, model)

    def run(batches):
        table, network = shared()
        for b in batches:
            cols = {c: b.column(c) for c in names}
            cols["score"] = pa.array(network.score(pooled(b.column("__text"), table)), pa.float64())
            yield pa.RecordBatch.from_pydict(cols)

    rows = documents.select(*names, F.col("text").alias("__text"))
    return rows.mapInArrow(run, with_fields(documents.select(*names).schema, "score double"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    """op5: score of every document."""
    from ledgerscope.sources.tables import read_table
    documents = read_table(spark, sf_dir, "documents")
    out = score_quality(documents, learn_quality(documents, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
