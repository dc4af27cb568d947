"""Near-duplicate groups by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles. ``m`` small
collections of ``r`` minhashes each are computed; every pair of collections
forms one table key, so m * r minhashes serve m * (m - 1) / 2 tables of 2 r
minhashes. Two sets of similarity s miss each other in all tables with
probability (1 - q)^m + m q (1 - q)^(m - 1), q = s^r: 5e-5 at s = 0.8, and 2e-6
at s = 0.85, for m = 18 and r = 3.

1. Documents with the same set form one class; the rest works on classes.
2. In each table, classes with the same key are compared with the smallest
   one (a star, never all pairs). Minhash agreement and set sizes prune,
   full sets confirm.
3. Where a family of candidates is still in several pieces after that, it is
   packed into blocks of classes, and every block of outsiders is compared
   with every block of the family inside a task, so that no link between
   different texts is lost. Only links that join pieces leave the task.
4. Connected components give each document the smallest doc_id it reaches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerscope.llm.components import connected_components
from ledgerscope.llm.store import write_table
from ledgerscope.llm.textarrays import U64, WordHasher, mix, text_slices, white_space_separators

COLLECTIONS = 18
PER_COLLECTION = 3
PERCENT = 80
PRUNE_BELOW = 0.55
BLOCK = 256
BLOCK_BYTES = 8 << 20  # and about so many bytes of text, or one longer text
SLICE_BYTES = 1 << 18


def shingle_sets(column: pa.Array, size: int, hasher: WordHasher):
    """Yield (first row, rows, set hashes, set bounds): sorted distinct shingles of each row."""
    for first, rows, data, off in text_slices(column, SLICE_BYTES):
        h, row, _, _ = hasher.words(data, off)
        count = np.bincount(row, minlength=rows)
        begin = np.concatenate([[0], np.cumsum(count)])
        if len(h) >= size:
            w = hasher.window_hash(h, size)
            inside = row[:len(w)] == row[size - 1:]
            w, owner = w[inside], row[:len(w)][inside]
        else:
            w, owner = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            w = np.concatenate([w, hasher.run_hash(h, begin[short], begin[short + 1]) ^ U64(size)])
            owner = np.concatenate([owner, short])
        order = np.lexsort((w, owner))
        w, owner = w[order], owner[order]
        if len(w):
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (owner[1:] != owner[:-1])
            w, owner = w[new], owner[new]
        yield first, rows, w, np.searchsorted(owner, np.arange(rows + 1))


def minhashes(w: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n minhashes (32 bits) of each set; rows of empty sets are 0."""
    rows = len(bounds) - 1
    out = np.zeros((rows, n), np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(full):
        return out
    starts = bounds[full]
    seeds = mix(np.arange(1, n + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
    half = (w ^ (w >> U64(29)))
    for k in range(n):
        x = half * seeds[k]
        x ^= x >> U64(32)
        x *= U64(0xE7037ED1A0B428DB)
        out[full, k] = np.minimum.reduceat((x >> U64(32)).astype(np.uint32), starts)
    return out


def signatures(documents: DataFrame, shingle: int, hashes: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, set digest (d1, d2) and minhashes of each row."""

    def run(batches):
        hasher = WordHasher(white_space_separators(), lower=True)
        for b in batches:
            n, d1, d2, mh = [], [], [], []
            for _, rows, w, bounds in shingle_sets(b.column("text"), shingle, hasher):
                total = np.concatenate([[U64(0)], np.cumsum(mix(w), dtype=U64)])
                other = np.concatenate([[U64(0)], np.cumsum(mix(w ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
                n.append(np.diff(bounds))
                d1.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                d2.append((other[bounds[1:]] - other[bounds[:-1]]).view(np.int64))
                mh.append(minhashes(w, bounds, hashes).view(np.int32))
            if not n:
                continue
            flat = np.concatenate(mh).reshape(-1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "th": b.column("th"), "n_shingles": pa.array(np.concatenate(n), pa.int64()),
                "d1": pa.array(np.concatenate(d1)), "d2": pa.array(np.concatenate(d2)),
                "mh": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, hashes), pa.int32()), pa.array(flat))})

    rows = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, th bigint, "
                                "n_shingles bigint, d1 bigint, d2 bigint, mh array<int>")


def table_keys(m: int, r: int):
    """Array of the m * (m - 1) / 2 table keys made from pairs of collections."""
    parts = [F.xxhash64(F.lit(i), *[F.col("mh")[i * r + k] for k in range(r)]).alias(f"c{i}") for i in range(m)]
    tuples = F.array(*parts)
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
    left, right = F.array(*[F.lit(i) for i, _ in pairs]), F.array(*[F.lit(j) for _, j in pairs])
    return tuples, F.transform(F.sequence(F.lit(0), F.lit(len(pairs) - 1)),
                               lambda p: F.xxhash64(p, F.col("tuples")[left[p]], F.col("tuples")[right[p]]))


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose full sets are similar enough."""
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a") \
        .select("a", "b", "text_a", "text_b")

    def run(batches):
        hasher = WordHasher(white_space_separators(), lower=True)
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                left = row_sets(part.column("text_a"), shingle, hasher)
                right = row_sets(part.column("text_b"), shingle, hasher)
                for k, (x, y) in enumerate(zip(left, right)):
                    both = common(x, y)
                    ok[at + k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return two.mapInArrow(run, "a bigint, b bigint")


def row_sets(column: pa.Array, shingle: int, hasher: WordHasher) -> list[np.ndarray]:
    return [w[s:e] for _, _, w, bounds in shingle_sets(column, shingle, hasher)
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def block_links(left, right, percent: int):
    """Links between the classes of two blocks that join different pieces: (a, b) pairs.

    ``left`` and ``right`` are lists of (node, piece, set). The intersections are
    counted through the postings of the right block.
    """
    values = np.concatenate([s for _, _, s in right])
    owner = np.repeat(np.arange(len(right)), [len(s) for _, _, s in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(s) for _, _, s in right])
    piece = {}

    def find(p):
        while piece.get(p, p) != p:
            p = piece[p]
        return p

    out = []
    for node, own, s in left:
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        width = hi - lo
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
        both = np.bincount(owner[at], minlength=len(right))
        for k in np.flatnonzero(100 * both >= percent * (len(s) + sizes - both)).tolist():
            p, q = find(own), find(right[k][1])
            if p != q:
                piece[p] = q
                out.append((node, right[k][0]))
    return out


def complete_families(pruned: DataFrame, comp: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between pieces of one candidate family that the stars did not test."""
    label = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    cross = pruned.join(label("a"), "a", "left").join(label("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct()
    family = connected_components(cross, "families").select(F.col("node").alias("piece"), F.col("comp").alias("family"))
    nodes = pruned.select(F.col("a").alias("node")).union(pruned.select("b")).distinct()
    members = nodes.join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("piece")).join(family, "piece")
    size = texts.select("node", F.octet_length("text").alias("size"))
    pieces = members.join(size, "node").groupBy("family", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = pieces.groupBy("family").agg(F.sum("n").alias("total"), F.sum("size").alias("bytes"), F.max(F.struct("n", "piece")).alias("top"))
    # a family of two classes has been compared by its star
    main = main.where("total > 2").select("family", F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"),
                                          F.col("top.piece").alias("main"))
    spread = members.join(main, "family").select(
        "family", "node", "piece", (F.col("piece") != F.col("main")).alias("outsider"), "blocks")
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    packed = spread.join(texts, "node").groupBy("family", "outsider", "block", "blocks").agg(
        F.collect_list(F.struct("node", "piece", "text")).alias("docs"))
    packed = write_table(packed, "family-blocks")
    sides = packed.where("outsider").select("family", F.col("block").alias("i"), F.col("docs").alias("left_docs"))
    others = packed.select("family", "outsider", F.col("block").alias("j"), F.col("docs").alias("right_docs"))
    tiles = sides.join(others, "family").where(~F.col("outsider") | (F.col("j") >= F.col("i"))).select("left_docs", "right_docs")

    def run(batches):
        hasher = WordHasher(white_space_separators(), lower=True)

        def unpack(docs):
            sets = row_sets(pa.array([d["text"] for d in docs], pa.string()), shingle, hasher)
            return [(d["node"], d["piece"], s) for d, s in zip(docs, sets)]

        for b in batches:
            out = []
            for k in range(b.num_rows):
                out += block_links(unpack(b.column("left_docs")[k].as_py()), unpack(b.column("right_docs")[k].as_py()), percent)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()),
                                              "b": pa.array([y for _, y in out], pa.int64())})

    return tiles.repartition(F.xxhash64("left_docs.node", "right_docs.node")).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = PERCENT,
                    m: int = COLLECTIONS, r: int = PER_COLLECTION) -> DataFrame:
    """One row per document: doc_id, th, n_shingles, component_id, kept.

    See ``grouped`` for what is linked; its comp is left out.
    """
    return grouped(documents, shingle, percent, m, r).drop("comp")


def grouped(documents: DataFrame, shingle: int, percent: int, m: int = COLLECTIONS, r: int = PER_COLLECTION) -> DataFrame:
    """One row per document: doc_id, th, n_shingles, component_id, comp, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a set
    holds the distinct runs of ``shingle`` words, or the whole word sequence
    if it is shorter. Documents are linked where 100 * intersection >= percent
    * union. component_id is the smallest doc_id reachable, kept tells whether it
    is the document's own. ``th`` is xxhash64 of the text; (doc_id, th) finds
    the row again; comp numbers the components, also those without any doc_id.
    Defined cases: null or empty texts and texts without words
    have an empty set and are linked with nothing; rows that share a doc_id are
    documents of their own; a null doc_id never becomes a component's id
    unless all its documents have none; other columns are ignored.
    """
    table = write_table(signatures(documents, shingle, m * r), "signatures")
    classes = table.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("th", "doc_id")).alias("rep"), F.first("mh").alias("mh"),
        F.first("n_shingles").alias("n_shingles"))
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    tuples, keys = table_keys(m, r)
    rows = classes.select("node", tuples.alias("tuples")).select("node", F.explode(keys).alias("key"))
    bucket = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stars = rows.withColumn("first", F.first("node").over(bucket)).where("first != node")
    pairs = write_table(stars.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "candidates")

    facts = classes.select("node", "mh", "n_shingles")
    agree = F.aggregate(F.zip_with("mh_a", "mh_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    near = pairs.join(facts.toDF("b", "mh_b", "n_b"), "b").join(facts.toDF("a", "mh_a", "n_a"), "a")
    pruned = write_table(near.where(agree >= int(PRUNE_BELOW * m * r)).select("a", "b", fits.alias("fits")), "pruned")

    wanted = pruned.select(F.col("a").alias("node")).union(pruned.select("b")).distinct()
    reps = classes.join(wanted, "node", "left_semi").select("node", F.col("rep.th").alias("th"), F.col("rep.doc_id").alias("rep_id"))
    own = documents.select(F.xxhash64("text").alias("th"), F.col("doc_id").alias("rep_id"), "text")
    found = own.join(reps, (own.th == reps.th) & own.rep_id.eqNullSafe(reps.rep_id)).select("node", "text")
    texts = write_table(found.dropDuplicates(["node"]), "class-texts")

    links = write_table(confirm(pruned.where("fits").select("a", "b"), texts, shingle, percent), "links")
    comp = connected_components(links)
    more = write_table(complete_families(pruned.select("a", "b"), comp, texts, shingle, percent), "more-links")
    if not more.isEmpty():
        comp = connected_components(links.union(more))
    labelled = classes.select("d1", "d2", "node", "low").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = labelled.groupBy("comp").agg(F.min("low").alias("component_id"))
    classed = write_table(labelled.join(lowest, "comp").select("d1", "d2", "component_id", "comp"), "class-components")
    full = table.where("n_shingles > 0").drop("mh").join(classed, ["d1", "d2"])
    empty = table.where("n_shingles = 0").drop("mh").withColumn("component_id", F.col("doc_id")) \
        .withColumn("comp", F.lit(None).cast("bigint"))
    out = full.select("doc_id", "th", "n_shingles", "component_id", "comp").union(
        empty.select("doc_id", "th", "n_shingles", "component_id", "comp"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """``documents`` with exactly one row of each near-duplicate group, all columns kept.

    The row with the smallest doc_id stays, among those the one with the
    smallest text hash, among repeated rows one by a hash of the row. Texts
    without words are in no group and stay.
    """
    rows = grouped(documents, shingle, percent).where("n_shingles > 0")
    rows = write_table(rows.groupBy("doc_id", "th", "comp", "kept").agg(F.count("*").alias("n")), "group-rows")
    lowest = rows.where("kept").groupBy("comp").agg(F.min("th").alias("best"))
    keepers = rows.where("kept").join(lowest, "comp")
    gone = rows.where(~F.col("kept")).select("doc_id", "th").union(keepers.where("th != best").select("doc_id", "th")) \
        .toDF("__id", "__th")
    twice = write_table(keepers.where("th = best AND n > 1").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), "repeated-rows")
    mark = documents.withColumn("__hash", F.xxhash64("text"))

    def meets(other: DataFrame):
        return F.col("doc_id").eqNullSafe(other["__id"]) & (F.col("__hash") == other["__th"])

    left = mark.join(gone, meets(gone), "left_anti")
    if twice.isEmpty():
        return left.drop("__hash")
    names = [F.col(f"`{c}`") for c in documents.columns]
    by = F.xxhash64(*[F.col(f"`{x.name}`") for x in documents.schema.fields if "map<" not in x.dataType.simpleString()])
    # min_by leaves one row per task and repeated row before anything moves
    one = left.join(twice, meets(twice), "left_semi").groupBy("doc_id", "__hash").agg(F.min_by(F.struct(*names), by).alias("__row"))
    return left.join(twice, meets(twice), "left_anti").select(*names).union(
        one.select(*[F.col(f"__row.`{c}`").alias(c) for c in documents.columns]))


def neardup_query(spark, sf_dir: str) -> DataFrame:
    """op6: groups by 2-word shingles at 80 %."""
    from ledgerscope.sources.tables import read_table
    out = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT rid, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[k] || ' ' || ws[k + 1] END AS g
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws), 2))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS nb FROM s x JOIN s y ON x.g = y.g AND x.rid < y.rid GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * nb >= 80 * (p.n + q.n - nb)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (
  SELECT rid AS a, rid AS b FROM w
  UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id IS NOT DISTINCT FROM m.component_id AS kept
FROM w LEFT JOIN n USING (rid)
JOIN (SELECT reach.a AS rid, min(w.doc_id) AS component_id FROM reach JOIN w ON w.rid = reach.b GROUP BY reach.a) m USING (rid)
"""
