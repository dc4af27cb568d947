"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers encode space + text, so their tokens cut the same bytes. Each
side is the array of its tokens' end offsets. While the tokens agree one to one,
the two arrays are equal at a fixed index shift: exponential probing compares
slices of 1, 2, 4, ... ends at that shift and jumps over the stretch. Where they
differ, the smaller end moves on until both meet again; that irregular group is
closed there and gives the new shift. Texts of a slice lie end to end, so one
walk serves them all: every text ends in a common end.

How often two ids are linked is counted over the corpus without a table on the
driver: a task writes, beside its documents, the pairs of each chunk of
documents with their sums; Spark adds these up, joins the sums back to the
chunks that hold the pair, and each chunk reads its own documents' links from
them. A chunk is bounded by its links.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.store import share, with_fields, write_table
from ledgerscope.llm.textarrays import text_slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# fixed values: the splitting pattern of the byte-level tokenizer
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_BYTES = 1 << 19
CHUNK_LINKS = 1 << 20
# runs of one kind of character beyond this length go to the tokenizer that cuts them in n log n steps
LONG_RUN = 2000


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabularies:
    """The two vocabulary files as bytes, read where their path is known."""

    byte_bpe: bytes
    pieces: bytes

    @classmethod
    def read(cls, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> "Vocabularies":
        with open(byte_bpe, "rb") as a, open(pieces, "rb") as b:
            return cls(a.read(), b.read())


class Encoders:
    """Tokenizers A and B of a task: ids of a text, bytes of an id."""

    def __init__(self, files: Vocabularies):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        model = json.loads(files.byte_bpe)["model"]
        special = {t["id"] for t in json.loads(files.byte_bpe)["added_tokens"]}
        alphabet = byte_alphabet()
        vocabulary = model["vocab"]
        self.a_bytes = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, k in vocabulary.items():
            if k not in special:
                self.a_bytes[k] = bytes(alphabet[c] for c in token)
        self.whole = Tokenizer.from_str(files.byte_bpe.decode())
        self.whole.encode_special_tokens = True
        # ids in the order of the merges can serve as ranks, which is the same encoding, only quicker
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.quick = None
        if all(x < y for x, y in zip(made, made[1:])):
            ranks = {b: k for k, b in enumerate(self.a_bytes) if b}
            self.quick = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in enumerate(self.b.id_to_piece(k) for k in range(self.b.get_piece_size()))]

    def a_ids(self, text: str) -> list[int]:
        if self.quick is not None and (len(text) < LONG_RUN or max(map(len, text.split(" "))) < LONG_RUN and "  " * LONG_RUN not in text):
            return self.quick.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def b_ids(self, text: str) -> list[int]:
        return self.b.encode(text, num_threads=1)


def decimal_digits(n: int) -> np.ndarray:
    """Row k holds the decimal digits of k as ASCII, aligned right, 0 before them."""
    width = len(str(max(n - 1, 0)))
    out = np.zeros((n, width), np.uint8)
    left = np.arange(n)
    for col in range(width - 1, -1, -1):
        shown = (left > 0) | (col == width - 1)
        out[shown, col] = 48 + left[shown] % 10
        left = left // 10
    return out


def walk(ea: list[int], eb: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices just past each group in A and in B. Both lists grow strictly and have the same last end."""
    n = len(ea)
    i = j = 0
    at_a, at_b, length = [], [], []  # stretches of groups: first group's last tokens and number of groups
    while i < n:
        if ea[i] == eb[j]:
            first, other, step = i, j, 1
            while i < n and ea[i:i + step] == eb[j:j + step]:
                i += step
                j += step
                step *= 2
            if i > n:
                j -= i - n
                i = n
            else:
                while step > 1:
                    step //= 2
                    if i + step <= n and ea[i:i + step] == eb[j:j + step]:
                        i += step
                        j += step
            at_a.append(first)
            at_b.append(other)
            length.append(i - first)
            if i >= n:
                break
        a, b = ea[i], eb[j]
        while a != b:
            if a < b:
                i += 1
                a = ea[i]
            else:
                j += 1
                b = eb[j]
        at_a.append(i)
        at_b.append(j)
        length.append(1)
        i += 1
        j += 1
    size = np.array(length, np.int64)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
    return np.repeat(np.array(at_a, np.int64), size) + place, np.repeat(np.array(at_b, np.int64), size) + place


def spelled_out(ids_a, ids_b, past_a, past_b, digits_a, digits_b):
    """ASCII of ``a1,a2|b1;a3|b2,b3;`` over all groups, and the number of bytes up to each group's end."""
    n_a, n_b = len(ids_a), len(ids_b)
    group_a = np.repeat(np.arange(len(past_a)), np.diff(past_a, prepend=0))
    group_b = np.repeat(np.arange(len(past_b)), np.diff(past_b, prepend=0))
    pos_a = np.arange(n_a) + (past_b - np.diff(past_b, prepend=0))[group_a]
    pos_b = np.arange(n_b) + past_a[group_b]
    width = max(digits_a.shape[1], digits_b.shape[1])
    out = np.zeros((n_a + n_b, width + 1), np.uint8)
    out[pos_a, width - digits_a.shape[1]:width] = digits_a[ids_a]
    out[pos_b, width - digits_b.shape[1]:width] = digits_b[ids_b]
    out[:, width] = ord(",")
    out[pos_a[past_a - 1], width] = ord("|")
    out[pos_b[past_b - 1], width] = ord(";")
    shown = out != 0
    upto = np.cumsum(shown.sum(axis=1))[past_a + past_b - 1]
    return out[shown], upto


class Aligner:
    """Aligns the texts of a slice; made once per task."""

    def __init__(self, encoders: Encoders):
        self.enc = encoders
        self.len_a = np.array([len(b) for b in encoders.a_bytes])
        self.len_b = np.array([len(b) for b in encoders.b_bytes])
        self.digits_a, self.digits_b = decimal_digits(len(self.len_a)), decimal_digits(len(self.len_b))
        self.bits = int(len(self.len_b) - 1).bit_length()

    def encode(self, text: str | None):
        """Ids of both tokenizers; none where a side does not give the bytes back."""
        if not text:
            return [], []
        spaced = " " + text
        raw = spaced.encode()
        a, b = self.enc.a_ids(spaced), self.enc.b_ids(text)
        table_a, table_b = self.enc.a_bytes, self.enc.b_bytes
        if b"".join([table_a[k] for k in a]) != raw or b"".join([table_b[k] for k in b]) != raw:
            return [], []
        return a, b

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Counts, groups and linked pairs of each text."""
        both = [self.encode(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.fromiter((i for x in both for i in x[k]), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        none = np.zeros(len(texts), np.int64)
        if not len(ids_a):
            return {"n_a": n_a, "n_b": n_b, "n_groups": none, "n_links": none, "groups": [""] * len(texts),
                    "width": none, "codes": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
        end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        past_a, past_b = walk(end_a.tolist(), end_b.tolist())
        upto_a = np.cumsum(n_a)
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        doc_b = np.repeat(np.arange(len(texts)), n_b)
        # groups as text; a text's last separator is left out
        shown, upto = spelled_out(ids_a, ids_b, past_a, past_b, self.digits_a, self.digits_b)
        groups_to = np.searchsorted(past_a, upto_a, side="right")
        n_groups = np.diff(groups_to, prepend=0)
        stop = np.append(0, upto)[groups_to]
        start = np.append(0, stop[:-1])
        raw = shown.tobytes()
        groups = [raw[s:max(e - 1, s)].decode("ascii") for s, e in zip(start.tolist(), stop.tolist())]
        # links: each token of A with the token of B over its last byte, and the reverse where no end is shared
        over = np.searchsorted(end_b, end_a)
        alone = np.ones(len(ids_b), bool)
        alone[past_b - 1] = False
        back = np.searchsorted(end_a, end_b[alone])
        code = np.concatenate([ids_a << self.bits | ids_b[over], ids_a[back] << self.bits | ids_b[alone]])
        doc = np.concatenate([doc_a, doc_b[alone]])
        wide = int(len(self.len_a) - 1).bit_length() + self.bits
        key, times = np.unique(doc << wide | code, return_counts=True)
        doc_of = key >> wide
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(texts)), "groups": groups,
                "width": np.bincount(doc_of, minlength=len(texts)), "codes": key & ((1 << wide) - 1), "times": times}


def lists(values: np.ndarray, width: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), pa.array(values))


def summed(codes: list[np.ndarray], times: list[np.ndarray]):
    """Distinct codes with their sums."""
    key, at = np.unique(np.concatenate(codes), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)


def align_tokens(documents: DataFrame, files: Vocabularies, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokens, groups and links of every row, and the sums of each chunk of rows.

    Rows with ``sums`` false are the documents: doc_id, the columns of
    ``keep``, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) and
    the links as codes (id of A, then id of B in ``pair_bits`` bits) with the
    times each occurs. Rows with ``sums`` true hold codes and times over their
    chunk only. Defined cases: a null or empty text, or one whose tokens do
    not give space + text back, has no tokens; repeated rows are documents of
    their own; other columns are ignored.
    """
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    schema = with_fields(documents.select(*names).schema,
                         "chunk bigint, sums boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
                         "codes array<bigint>, times array<bigint>")
    shared = share(documents.sparkSession, files)

    def run(batches):
        aligner = Aligner(Encoders(shared()))
        chunk = TaskContext.get().partitionId() << 32
        codes, times, links = [], [], 0

        def sums(types):
            key, total = summed(codes, times)
            n = 1 << 16
            for at in range(0, len(key), n):
                part = key[at:at + n]
                size = np.array([len(part)])
                yield pa.RecordBatch.from_pydict(
                    {c: pa.nulls(1, t) for c, t in types.items()} | {
                        "chunk": pa.array([chunk]), "sums": pa.array([True]),
                        **{c: pa.nulls(1, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups": pa.nulls(1, pa.string()),
                        "codes": lists(part, size), "times": lists(total[at:at + n], size)})

        types = None
        for b in batches:
            types = {c: b.column(c).type for c in names}
            column = b.column("__text")
            for at, n, _, _ in text_slices(column, SLICE_BYTES):
                got = aligner.align(column.slice(at, n).to_pylist())
                yield pa.RecordBatch.from_pydict(
                    {c: b.column(c).slice(at, n) for c in names} | {
                        "chunk": pa.array(np.full(n, chunk)), "sums": pa.array(np.zeros(n, bool)),
                        **{c: pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups": pa.array(got["groups"], pa.string()),
                        "codes": lists(got["codes"], got["width"]), "times": lists(got["times"], got["width"])})
                codes.append(got["codes"])
                times.append(got["times"])
                links += len(got["codes"])
                if links >= CHUNK_LINKS:
                    yield from sums(types)
                    chunk += 1
                    codes, times, links = [], [], 0
        if links:
            yield from sums(types)

    return documents.select(*names, F.col("text").alias("__text")).mapInArrow(run, schema)


def pair_bits(files: Vocabularies) -> int:
    """Bits of the B id at the low end of a pair's code."""
    import sentencepiece
    return int(sentencepiece.SentencePieceProcessor(model_proto=files.pieces).get_piece_size() - 1).bit_length()


def link_counts(aligned: DataFrame, bits: int) -> DataFrame:
    """(code, count, best): how often each pair is linked in the corpus, and whether no pair of its B id is linked more often."""
    chunks = aligned.where("sums").select(F.explode(F.arrays_zip("codes", "times")).alias("p"))
    counts = chunks.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("count"))
    counts = write_table(counts.withColumn("b", F.col("code").bitwiseAND((1 << bits) - 1)), "link-counts")
    # one row per B id: the vocabulary bounds it
    top = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(top), "b").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def with_link_counts(aligned: DataFrame, counts: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of the documents of ``aligned`` (a written table), with n_best and count_sum."""
    local = aligned.where("sums").select(F.col("chunk").alias("of"), F.explode("codes").alias("code")).join(counts, "code")
    rows = aligned.where("NOT sums").select("chunk", *keep, "codes", "times")
    schema = with_fields(rows.select(*keep).schema, "n_best bigint, count_sum bigint")

    def read(docs, known):
        if not docs.num_rows:
            return pa.table({f: pa.array([], docs.column(f).type) for f in keep} | {
                "n_best": pa.array([], pa.int64()), "count_sum": pa.array([], pa.int64())})
        known = known.combine_chunks()
        code = known.column("code").to_numpy()
        order = np.argsort(code)
        code, count = code[order], known.column("count").to_numpy()[order]
        best = known.column("best").to_numpy(zero_copy_only=False)[order]
        codes, times = docs.column("codes").combine_chunks(), docs.column("times").combine_chunks()
        width = codes.value_lengths().to_numpy()
        times = times.flatten().to_numpy()
        at = np.searchsorted(code, codes.flatten().to_numpy())
        upto = np.append(0, np.cumsum(width))
        total, good = np.append(0, np.cumsum(times * count[at])), np.append(0, np.cumsum(times * best[at]))
        return pa.table({f: docs.column(f) for f in keep} | {
            "n_best": pa.array(good[upto[1:]] - good[upto[:-1]]), "count_sum": pa.array(total[upto[1:]] - total[upto[:-1]])})

    return rows.groupBy("chunk").cogroup(local.groupBy("of")).applyInArrow(read, schema)


def alignment_query(spark, sf_dir: str) -> DataFrame:
    """op13: groups and links of the byte-level and the piece tokenizer on every document."""
    from ledgerscope.sources.tables import read_table
    files = Vocabularies.read()
    aligned = align_tokens(read_table(spark, sf_dir, "documents"), files)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    aligned = write_table(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return with_link_counts(aligned, link_counts(aligned, pair_bits(files)),
                            ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
