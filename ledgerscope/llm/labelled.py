"""Bounded, repeatable samples of labelled texts for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.llm.store import bound_batches, write_table


def fold(doc_id: str, folds: int, held: int) -> Column:
    """True for rows that no label may be learnt from: crc32 of the id as text, mod ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == held, F.lit(False))


SAMPLE_BYTES = 64 << 20


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: dict[int, int],
                  seed: int = 11, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``per_class[c]`` rows (text, y, h, doc_id) of each class y = c, chosen by a hash h of the id.

    Only ids for which ``learn`` (an expression over doc_id) holds and that
    have a document with a text are drawn, each once: of rows that repeat an
    id, the text with the smallest hash teaches. Texts are taken in the order of the
    hash while they hold ``most_bytes`` together, the classes in turn, so the
    driver's memory has a bound whatever the lengths. An id labelled with both
    classes teaches both.
    """
    have = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id")
    order = F.xxhash64(F.lit(seed), "doc_id")
    picked = None
    for c, most in per_class.items():
        ids = labels.where(learn & (F.col(label) == c)).select("doc_id").distinct().join(have, "doc_id", "left_semi") \
            .orderBy(order, "doc_id").limit(most).withColumn("y", F.lit(c))
        picked = ids if picked is None else picked.union(ids)
    # the ids are bounded by the classes' limits
    rows = documents.select(F.col("doc_id").alias("__id"), "text").where("text IS NOT NULL") \
        .join(F.broadcast(picked), F.col("__id") == F.col("doc_id"))
    one = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    one = write_table(one.withColumn("h", order), "labelled-sample")
    size = one.select("doc_id", "y", "h", F.octet_length("text").alias("n")).orderBy("h", "doc_id", "y").collect()
    rank, left, chosen = {}, most_bytes, []
    turns = []
    for r in size:
        rank[r.y] = rank.get(r.y, 0) + 1
        turns.append((rank[r.y], r.y, r.h, r.doc_id, r.n))
    for _, y, h, doc_id, n in sorted(turns, key=lambda t: (t[0], t[1])):
        if n <= left:
            left -= n
            chosen.append((doc_id, y))
    wanted = documents.sparkSession.createDataFrame(chosen, one.select("doc_id", "y").schema)
    return one.join(F.broadcast(wanted), ["doc_id", "y"]).select("text", "y", "h", "doc_id")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: dict[int, int], **more) -> list[tuple[str, int]]:
    """The (text, class) pairs of ``labelled_rows`` on the driver, in the order of the hash."""
    got = labelled_rows(documents, labels, label, learn, per_class, **more).orderBy("h", "doc_id", "y").toArrow()
    return list(zip(got.column("text").to_pylist(), got.column("y").to_pylist()))


def fit_in_task(rows: DataFrame, fit: Callable[[list[tuple[str, int]]], Any]) -> dict:
    """The attributes of ``fit(pairs)``, fitted on ``labelled_rows`` inside one task.

    The sample and all that is made of it stay in a worker; only the model's
    arrays come back. A lost executor costs one more fit.
    """

    def run(batches):
        pairs = []
        for b in batches:
            pairs += zip(b.column("text").to_pylist(), b.column("y").to_pylist())
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(vars(fit(pairs)))], pa.binary())})

    bound_batches(rows.sparkSession)
    got = rows.repartition(1).sortWithinPartitions("h", "doc_id", "y").mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else vars(fit([]))
