"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic. A word's emission is the sum of hashed feature
weights: the word, its first 3 to 6 bytes and its last 4. Transitions link
neighbouring words. Forward-backward gives each word's marginal; a document's
score is the calibrated odds of its most toxic word, and runs of words above
one half are the offending offsets.

The labels mark documents, so the words of the sample are labelled first: in
toxic documents, words with a feature whose document frequencies differ from
the clean ones beyond chance; then the fitted field labels them again.

The fit uses a bounded sample (SAMPLE documents per class, by a hash of the
id) of rows outside the held-out fold, inside one task. Scoring is one narrow pass over all
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.labelled import fit_in_task, fold, labelled_rows
from ledgerscope.llm.neardup import minhashes, shingle_sets
from ledgerscope.llm.store import share, with_fields
from ledgerscope.llm.textarrays import U64, WordHasher, mix, symbol_separators, text_slices

SAMPLE = {1: 1200, 0: 2000}
BITS = 20
SEGMENT = 64
THRESHOLD = 0.3
GROUP_WORDS = 1 << 20
SLICE_BYTES = 1 << 19
KINDS = 6


def word_features(hasher: WordHasher, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit features of each word: (words, KINDS); 0 where a word is too short for one."""
    prefix = hasher.prefix(data)
    out = np.zeros((len(start), KINDS), U64)
    out[:, 0] = hasher.span_hash(prefix, start, end)
    for k, n in enumerate((3, 4, 5, 6), 1):
        fits = end - start >= n
        out[fits, k] = mix(hasher.span_hash(prefix, start[fits], start[fits] + n) + U64(k))
    fits = end - start > 4
    out[fits, 5] = mix(hasher.span_hash(prefix, end[fits] - 4, end[fits]) + U64(5))
    return out


def buckets(features: np.ndarray) -> np.ndarray:
    """Weight index of each feature; bucket 0 (weight 0) for absent ones."""
    at = (features >> U64(64 - BITS)).astype(np.int32)
    at[features == 0] = 0
    return at


class Field:
    """Weights of the field and the calibration of document scores."""

    def __init__(self):
        self.w = np.zeros(1 << BITS, np.float32)
        self.bias = -4.0
        self.trans = np.array([0.0, 0.0, 0.0])  # clean>toxic, toxic>clean, toxic>toxic; clean>clean is 0
        self.slope, self.offset = 1.0, 0.0
        self.fitted = False

    def emissions(self, at: np.ndarray) -> np.ndarray:
        return self.w[at].sum(axis=1) + self.bias

    def odds(self, u: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Forward ratios, backward ratios and exp(emission) of every word, lanes of sequences side by side."""
        e = np.exp(np.clip(u, -30, 30)).astype(np.float64)
        k_ot, k_to, k_tt = np.exp(self.trans)
        r, q = np.empty_like(e), np.ones_like(e)
        order = np.argsort(-lengths, kind="stable")
        first, size = starts[order], lengths[order]
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
        prev = np.zeros(len(first))
        for t in range(steps):
            n = live[t]
            at = first[:n] + t
            p = prev[:n]
            now = e[at] * (k_ot + p * k_tt) / (1.0 + p * k_to) if t else e[at] * k_ot
            r[at] = now
            prev = now
        last = first + size - 1
        nxt = None
        for t in range(steps):
            n = live[t]
            at = last[:n] - t
            if t:
                f = nxt[:n]
                now = (k_to + k_tt * f) / (1.0 + k_ot * f)
                q[at] = now
                nxt = e[at] * now
            else:
                nxt = e[at] * 1.0
        return r, q, e

    def marginals(self, u, starts, lengths):
        r, q, _ = self.odds(u, starts, lengths)
        return r * q

    def fit_words(self, at: np.ndarray, y: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rounds: int):
        """Maximise the regularised likelihood of word labels by Adam over the whole sample."""
        met = np.zeros(1 << BITS, bool)
        met[at.reshape(-1)] = True
        used = np.flatnonzero(met)
        dense = (np.cumsum(met, dtype=np.int32) - 1)[at]
        w = self.w[used].astype(np.float64)
        extra = np.concatenate([[self.bias], self.trans])
        theta = np.concatenate([w, extra])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        none = used == 0
        head = np.zeros(len(y), bool)
        head[starts] = True
        prev = np.concatenate([[0], y[:-1]])
        prev[head] = 0
        seen = np.array([((prev == 0) & (y == 1)).sum(), ((prev == 1) & (y == 0) & ~head).sum(),
                         ((prev == 1) & (y == 1)).sum()], float)
        for step in range(1, rounds + 1):
            self.bias, self.trans = theta[-4], theta[-3:]
            u = np.full(len(y), self.bias)
            for k in range(dense.shape[1]):
                u += theta[dense[:, k]]
            r, q, e = self.odds(u, starts, lengths)
            p = r * q / (1.0 + r * q)
            k_ot, k_to, k_tt = np.exp(self.trans)
            before = np.concatenate([[0.0], r[:-1]])
            before[head] = 0.0
            parts = np.stack([k_ot * e * q, before * k_to, before * k_tt * e * q])
            expect = (parts / (1.0 + parts.sum(axis=0))).sum(axis=1)
            diff = y - p
            g = np.zeros_like(theta)
            for k in range(dense.shape[1]):
                g[:-4] += np.bincount(dense[:, k], weights=diff, minlength=len(w))
            g[-4] = diff.sum()
            g[-3:] = seen - expect
            g -= 0.5 * np.concatenate([theta[:-4], [0.0], theta[-3:]])
            g[:-4][none] = 0.0
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            theta = theta + 0.25 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        self.w[used] = theta[:-4]
        self.w[0] = 0.0
        self.bias, self.trans = float(theta[-4]), theta[-3:].copy()


def marked_words(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Words of toxic documents with a feature that is more frequent there than chance allows."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    flagged = np.zeros(len(doc), bool)
    best = (-1.0, None)
    for k in range(KINDS - 1):
        f = features[:, k]
        ok = f != 0
        if not ok.any():
            continue
        g, d = f[ok], doc[ok]
        order = np.lexsort((d, g))
        g, d = g[order], d[order]
        new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))
        g, d = g[new], d[new]
        first = np.append(True, g[1:] != g[:-1])
        names, which = g[first], np.cumsum(first) - 1
        in_toxic = np.bincount(which, weights=toxic[d], minlength=len(names))
        in_clean = np.bincount(which, minlength=len(names)) - in_toxic
        p, q = (in_toxic + 0.5) / (n_toxic + 1), (in_clean + 0.5) / (n_clean + 1)
        total = in_toxic + in_clean
        rate = n_toxic / (n_toxic + n_clean)
        share = np.clip(in_toxic / total, 1e-9, 1 - 1e-9)
        gain = total * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
        good = (gain > np.log(len(names)) + 3) & (p > 20 * q) & (in_toxic > 0.9 * total)
        rank = np.where(p > q, gain, -1)
        if rank.max() > best[0]:
            best = (rank.max(), (k, names[rank.argmax()]))
        hit = np.isin(f, names[good])
        flagged |= hit & ok
    if not flagged.any() and best[1]:
        flagged = features[:, best[1][0]] == best[1][1]
    return flagged & toxic[doc]


def without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without near copies, whose shared rare words would look significant."""
    hasher, out, seen = WordHasher(symbol_separators(), lower=True), [], set()
    for at, rows, w, bounds in shingle_sets(pa.array([t for t, _ in sample], pa.large_string()), 3, hasher):
        mh = minhashes(w, bounds, 8)
        for k in range(rows):
            if bounds[k] == bounds[k + 1]:
                continue
            marks = [(j, int(mh[k, j]), int(mh[k, j + 1])) for j in range(0, 8, 2)]
            if not any(x in seen for x in marks):
                out.append(sample[at + k])
            seen.update(marks)
    return out


def fit(sample: list[tuple[str, int]]) -> Field:
    """Field fitted on (text, label) pairs; an unfitted one scores everything 0 if a class is missing."""
    field = Field()
    sample = without_copies(sample)
    if len({y for _, y in sample}) < 2:
        return field
    hasher = WordHasher(symbol_separators(), lower=True)
    column = pa.array([t for t, _ in sample], pa.large_string())
    parts, docs = [], []
    for at, _, data, off in text_slices(column, SLICE_BYTES):
        start, end, row = hasher.bounds(data, off)
        parts.append(word_features(hasher, data, start, end))
        docs.append(row + at)
    features, doc = np.concatenate(parts), np.concatenate(docs)
    del parts
    toxic = np.array([y for _, y in sample], bool)
    if not len(doc):
        return field
    y = marked_words(features, doc, toxic).astype(np.int64)
    at = buckets(features)
    del features
    # segments of at most SEGMENT words, none across documents
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    starts = np.flatnonzero((place % SEGMENT) == 0)
    lengths = np.diff(np.append(starts, len(doc)))
    whole = np.flatnonzero(place == 0)
    whole_length = np.diff(np.append(whole, len(doc)))
    # one document in four calibrates and teaches no word
    teach = doc % 4 != 3
    own = np.flatnonzero(teach)
    shift = np.cumsum(teach) - teach
    mine = teach[starts]
    for rounds in (40, 30):
        field.fit_words(at[own], y[own], shift[starts[mine]], lengths[mine], rounds)
        odds = field.marginals(field.emissions(at), whole, whole_length)
        if rounds == 30:
            break
        y = ((odds > 3) & toxic[doc]).astype(np.int64)
        top = np.maximum.reduceat(odds, whole)
        silent = toxic[doc[whole]] & (top <= 3) & (top > 0.1)
        for k in np.flatnonzero(silent):
            y[whole[k] + int(odds[whole[k]:whole[k] + whole_length[k]].argmax())] = 1
    top = np.log(np.maximum.reduceat(odds, whole) + 1e-12)
    unseen = ~teach[whole]
    field.slope, field.offset = calibrate(top[unseen], toxic[doc[whole[unseen]]])
    field.fitted = True
    return field


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset of y on x by Newton steps with a weak prior."""
    a, b = 0.5, 0.0
    x = np.clip(x, -15, 15)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(x * (y - p)).sum() - 0.5 * (a - 0.5), (y - p).sum() - 0.05 * b])
        s = p * (1 - p)
        hess = np.array([[(s * x * x).sum() + 0.5, (s * x).sum()], [(s * x).sum(), s.sum() + 0.05]])
        step = np.linalg.solve(hess, g)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.05), b


def score_rows(column: pa.Array, field: Field):
    """(score, offending (start, stop) code points) of each row."""
    hasher = WordHasher(symbol_separators(), lower=True)
    pending, words = [], 0
    for piece in text_slices(column, SLICE_BYTES):
        _, rows, data, off = piece
        start, end, row = hasher.bounds(data, off)
        u = field.emissions(buckets(word_features(hasher, data, start, end)))
        pending.append((rows, data, off, start, end, row, u))
        words += len(u)
        if words >= GROUP_WORDS:
            yield from score_group(pending, field)
            pending, words = [], 0
    if pending:
        yield from score_group(pending, field)


def score_group(pending, field: Field):
    u = np.concatenate([p[6] for p in pending])
    counts = np.concatenate([np.bincount(p[5], minlength=p[0]) for p in pending])
    begin = np.concatenate([[0], np.cumsum(counts)])
    full = np.flatnonzero(counts)
    odds = field.marginals(u, begin[full], counts[full]) if len(full) else np.zeros(0)
    top = np.full(len(counts), -15.0)
    if len(full):
        top[full] = np.clip(np.log(np.maximum.reduceat(odds, begin[full]) + 1e-12), -15, 15)
    score = 1 / (1 + np.exp(-(field.slope * top + field.offset))) if field.fitted else np.zeros(len(counts))
    doc, word = 0, 0
    for rows, data, off, start, end, row, own in pending:
        hot = np.flatnonzero(odds[word:word + len(own)] > 1) if field.fitted else np.zeros(0, np.int64)
        spans: dict[int, list] = {}
        if len(hot):
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            zero = chars[off[:-1]]
            last = None
            for k in hot.tolist():
                r = int(row[k])
                s, e = int(chars[start[k]] - zero[r]), int(chars[end[k]] - zero[r])
                if last == k - 1 and spans.get(r):
                    spans[r][-1]["stop"] = e
                else:
                    spans.setdefault(r, []).append({"start": s, "stop": e})
                last = k
        for r in range(rows):
            yield float(score[doc + r]), spans.get(r, [])
        doc, word = doc + rows, word + len(own)


def score_toxicity(documents: DataFrame, field: Field, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, score (0 to 1) and spans (code points [start, stop)) of every row.

    Defined cases: a null or empty text, or one without words, has the score
    of the least toxic word and no spans; without both classes in the sample
    every score is 0; repeated rows are scored one by one; other columns are
    ignored.
    """
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    shared = share(documents.sparkSession, field)
    source = "text" if "text" in names else "__text"
    rows = documents.select(*names, *([] if "text" in names else [F.col("text").alias("__text")]))

    def run(batches):
        model = shared()
        for b in batches:
            scored = list(score_rows(b.column(source), model))
            cols = {c: b.column(c) for c in names}
            cols["score"] = pa.array([s for s, _ in scored], pa.float64())
            cols["spans"] = pa.array([x for _, x in scored], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(run, with_fields(documents.select(*names).schema,
                                            "score double, spans array<struct<start:bigint,stop:bigint>>"))


def learn_toxicity(documents: DataFrame, labels: DataFrame) -> Field:
    """Field from the labelled rows outside the held-out fold."""
    field = Field()
    vars(field).update(fit_in_task(labelled_rows(documents, labels, "toxic", ~fold("doc_id", 4, 2), SAMPLE), fit))
    return field


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    """op3: score of every document."""
    from ledgerscope.sources.tables import read_table
    documents = read_table(spark, sf_dir, "documents")
    out = score_toxicity(documents, learn_toxicity(documents, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
