"""Sinks and sources for panels, feature tables and result documents.

Everything is written under the shared folder named by
``spark.checkpoint.dir`` (never a machine-local path on a cluster) and
read back with an explicit schema.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.session import shared_dir
from ledgerscope.sources.ledger import PANEL_SCHEMA
from ledgerscope.sources.panel_store import DAYS_AS_DIFFERENCES

# one JSON object per line in each document
RESULT_DOCS = {
    "classification_report": "model string, class string, precision double, recall double, f1 double, support bigint",
    "clustering": "k int, inertia double, silhouette double",
    "forecast_metrics": "segment string, model string, rmse double, mae double, mape double, n_test bigint",
    "statistical_tests": "test string, statistic double, p_value double, significant boolean",
}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("compression", "gzip").csv(path)


TEXT_BYTES = 4_000_000      # text of days handed over at once
TEXT_DAYS = 4096            # days of a run written as one text


def write_runs_csv(runs: DataFrame, path: str) -> None:
    """The daily panel of ``runs`` (see ``ledger.ledger_to_runs``), the same lines as ``write_csv`` of its days.

    What the lines of a run share is made once, by Spark's CSV writer; its days are filled in as one block of bytes.
    """
    shared = runs.where("first_day <= last_day").select(
        F.to_csv(F.struct("customer_id", "segment")).cast("binary").alias("head"), F.unix_date("first_day").alias("first"),
        (F.datediff("last_day", "first_day") + 1).alias("days"), F.when(F.col("balance").isNull(), "").otherwise(F.to_csv(F.struct("balance"))).cast("binary").alias("tail"))

    def lines(batches):
        yield pa.RecordBatch.from_pydict({"value": pa.array(["customer_id,segment,date,balance"])})
        low, high, dates = 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            first, days = (b.column(c).to_numpy().astype(np.int64) for c in ("first", "days"))
            if dates is None or first.min() < low or (first + days).max() > high:
                low, high = (first.min(), (first + days).max()) if dates is None else (min(low, first.min()), max(high, (first + days).max()))
                dates = np.datetime_as_string(np.arange(low, high).astype("datetime64[D]")).astype("S10").view(np.uint8).reshape(-1, 10)
            out, held = [], 0
            for head, start, n, tail in zip(b.column("head").to_pylist(), (first - low).tolist(), days.tolist(), b.column("tail").to_pylist()):
                head, tail = np.frombuffer(head + b",", np.uint8), np.frombuffer(b"," + tail + b"\n", np.uint8)
                for at in range(start, start + n, TEXT_DAYS):
                    some = dates[at:min(at + TEXT_DAYS, start + n)]
                    text = np.empty((len(some), len(head) + 10 + len(tail)), np.uint8)
                    text[:, :len(head)], text[:, len(head):-len(tail)], text[:, -len(tail):] = head, some, tail
                    out.append(text.tobytes()[:-1])     # the writer ends the last line
                    held += text.size
                    if held > TEXT_BYTES:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary()).cast(pa.string())})
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary()).cast(pa.string())})

    shared.mapInArrow(lines, "value string").write.option("compression", "gzip").text(path)


def _span(date: str = "date"):
    """The stretch of 64 days that a day lies in, and the day's bit in it."""
    day = F.unix_date(date)
    return F.shiftright(day, 6).alias("_span"), F.expr(f"shiftleft(1L, unix_date({date}) & 63)")


def scan_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a balance CSV with the verdict on it.

    Columns of the panel, ``line`` (the text of a line that does not parse) and
    ``status``: ``malformed`` where a value is missing or does not fit its
    type; ``duplicate`` for all but one row of a customer and day (the lowest
    balance is kept, whatever the order of the file); else ``accepted``. The
    declared schema is read permissively, so a bad line costs itself only. The lines
    are parsed once, at call time, and the parsed rows written down, as are the stretches of
    days of a customer that hold a day twice.
    """
    schema = PANEL_SCHEMA + ", line STRING"
    base = results_base(spark)
    spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").csv(path).write.options(
        **DAYS_AS_DIFFERENCES).parquet(base + "/parsed")
    rows = spark.read.schema(schema).parquet(base + "/parsed")
    bad = F.col("line").isNotNull() | F.col("customer_id").isNull() | F.col("segment").isNull() \
        | F.col("date").isNull() | F.col("balance").isNull() | F.isnan("balance")
    span, bit = _span()
    sound = rows.where(~bad).withColumn("_span", span)
    # a stretch with as many rows as different days holds none twice; only the rows of other stretches are dealt by day
    some = sound.groupBy("customer_id", "_span").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("days")).where("n > bit_count(days)")
    some.select("customer_id", "_span").write.parquet(base + "/repeated")
    repeated = spark.read.schema("customer_id BIGINT, _span INT").parquet(base + "/repeated")
    # malformed rows have no key of their own to be dealt by
    place = F.row_number().over(Window.partitionBy("customer_id", "date").orderBy("balance", "segment"))
    key = ["customer_id", "_span"]
    dealt = sound.join(repeated, key, "left_semi").withColumn("status", F.when(place == 1, "accepted").otherwise("duplicate"))
    single = sound.join(repeated, key, "left_anti").withColumn("status", F.lit("accepted"))
    sound = single.unionByName(dealt).select(*rows.columns, "status")
    return sound.unionByName(rows.where(bad).withColumn("status", F.lit("malformed")))


def read_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """The accepted rows of a balance CSV."""
    return scan_panel_csv(spark, path).where("status = 'accepted'").drop("line", "status")


def panel_gaps(panel: DataFrame) -> DataFrame:
    """customer_id, gap_start, gap_end, n_days of the days missing between a customer's rows.

    A customer's days are put together as bits of stretches, so stretches and not days are sorted.
    """
    span, bit = _span()
    spans = panel.groupBy("customer_id", span).agg(
        F.bit_or(bit).alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))
    nxt = F.lead("first").over(Window.partitionBy("customer_id").orderBy("_span"))
    after = F.expr("array(struct(date_add(last, 1) AS gap_start, date_sub(next, 1) AS gap_end))")
    held = "filter(sequence(first, last), d -> getbit(days, unix_date(d) & 63) = 1)"
    inner = F.expr(f"zip_with({held}, slice({held}, 2, 64), (a, b) -> struct(date_add(a, 1) AS gap_start, date_sub(b, 1) AS gap_end))")
    whole = F.expr("bit_count(days) = datediff(last, first) + 1")
    gaps = spans.withColumn("next", nxt).where(~whole | F.expr("next > date_add(last, 1)")).select(
        "customer_id", F.explode(F.when(whole, after).otherwise(F.concat(inner, after))).alias("g")).select("customer_id", "g.*")
    return gaps.where("gap_start <= gap_end").withColumn("n_days", (F.datediff("gap_end", "gap_start") + 1).cast("bigint"))


def fill_gaps(panel: DataFrame) -> DataFrame:
    """The panel with missing days carrying the balance before them, so that it is complete again."""
    nxt = F.lead("date").over(Window.partitionBy("customer_id").orderBy("date"))
    runs = panel.select("customer_id", "segment", "date", F.coalesce(F.date_sub(nxt, 1), F.col("date")).alias("until"), "balance")
    return runs.select("customer_id", "segment", F.explode(F.sequence("date", "until")).alias("date"), "balance")


def quarantine_counts(scanned: DataFrame) -> DataFrame:
    """status, n: accepted, malformed and duplicate rows and the missing days, each status present."""
    counts = scanned.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    missing = panel_gaps(scanned.where("status = 'accepted'")).agg(F.lit("gap_day").alias("status"), F.coalesce(F.sum("n_days"), F.lit(0)).alias("n"))
    names = scanned.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in ("accepted", "malformed", "duplicate", "gap_day")])).alias("status"))
    return names.join(counts.unionByName(missing), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def write_docs(docs: dict[str, DataFrame], base: str) -> None:
    """One JSON-lines folder per document name (one row per line, written
    by every task in parallel; nothing is gathered into a single row)."""
    for name, df in docs.items():
        df.write.option("ignoreNullFields", False).json(f"{base}/{name}")


def read_doc(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One document, parsed with its schema."""
    return spark.read.schema(RESULT_DOCS[name]).json(f"{base}/{name}")


def doc_exists(spark: SparkSession, base: str, name: str) -> bool:
    """Whether the document was written, on whatever file system ``base`` lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_docs(spark: SparkSession, base: str, names) -> DataFrame:
    """doc, field, value of every expected document in ``names``: one row per
    item and field, so that documents of different shape share one table.
    A document that was not written is one row with null field and value;
    lines that do not parse are left out (see ``doc_status``)."""
    out = spark.createDataFrame([(n,) for n in names if not doc_exists(spark, base, n)], "doc string").select(
        "doc", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
    for name in names:
        if not doc_exists(spark, base, name):
            continue
        doc = scan_doc(spark, base, name).where("line IS NULL").drop("line")
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in doc.columns])
        out = out.unionByName(doc.select(F.lit(name).alias("doc"), F.explode(pairs).alias("p")).select("doc", "p.field", "p.value"))
    return out


def scan_doc(spark: SparkSession, base: str, name: str) -> DataFrame:
    """All lines of a document, parsed with its schema; ``line`` holds the text of one that does not parse."""
    parsed = F.from_json("value", RESULT_DOCS[name] + ", line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line"})
    return spark.read.text(f"{base}/{name}").where("trim(value) <> ''").select(parsed.alias("r")).select("r.*")


def doc_status(spark: SparkSession, base: str, names=tuple(RESULT_DOCS)) -> DataFrame:
    """doc, n_accepted, n_rejected of the expected documents; both null where a document is absent."""
    expected = spark.createDataFrame([(n,) for n in names], "doc string")
    found = None
    for name in names:
        if doc_exists(spark, base, name):
            one = scan_doc(spark, base, name).agg(
                F.lit(name).alias("doc"), F.count_if(F.col("line").isNull()).alias("n_accepted"), F.count_if(F.col("line").isNotNull()).alias("n_rejected"))
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "doc string, n_accepted bigint, n_rejected bigint")
    return expected.join(F.broadcast(found), "doc", "left")


def results_base(spark: SparkSession) -> str:
    """A folder of its own for every call, so no run overwrites what another still reads."""
    return shared_dir(spark, f"ledgerscope-results/{uuid.uuid4().hex}")
