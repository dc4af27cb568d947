"""Training-corpus pipeline over ``documents``: five stages, each one of the library's operators.

1. toxicity: documents scored 0.3 or more by the conditional random field go.
2. near_duplicates: one document of each MinHash group stays (5-word shingles, 80 %).
3. substring_dedup: words inside repeated 35-word windows are cut out of the texts.
4. decontamination: documents with an occurring benchmark window go.
5. mixing: how many words of each document the mix of sources takes.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. Rows travel through Python packed in one
struct, so columns of any name pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.llm import decontaminate, mixing, neardup, substring, toxicity
from ledgerscope.llm.store import write_table
from ledgerscope.sources.tables import read_table

ROW = "__row"


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns but the text as one column."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(ROW))


def unpacked(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("text") if c == "text" else F.col(f"{ROW}.`{c}`").alias(c)
                         for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, all columns; null and empty texts stay."""
    field = toxicity.learn_toxicity(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(packed(docs), field, keep=(ROW, "text"))
    return unpacked(scored.where(F.col("score") < toxicity.THRESHOLD), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, of the smallest doc_id; texts without words are in no group and stay."""
    return neardup.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those that hold repeated windows keep their other words, joined by one space."""
    cut = substring.remove_repeats(packed(docs), keep=(ROW,), as_is=True)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)) \
            .otherwise(F.col(f"{ROW}.n_chars"))
    return unpacked(cut, docs, **new)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.find_contamination(packed(docs), read_table(spark, sf_dir, "benchmark"), keep=(ROW, "text"))
    return unpacked(found.where(F.size("items") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken."""
    return mixing.mix_sources(docs, keep=("source",))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

# Learnt scores, MinHash groups and seeded selection have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
