"""Classification metric tables over (actual, predicted, score) rows.

All of them are aggregates over the confusion counts, which have one row
per (actual, predicted) pair: bounded by classes squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.expr import half_up
from ledgerscope.operators.ranking import average_rank, global_row_number, running_sums


def label_encode(df: DataFrame, col: str, out: str = "label_index") -> DataFrame:
    """Alphabetical class index (0-based), from the distributed row number of the distinct values; NULL has none."""
    classes = df.select(col).where(F.col(col).isNotNull()).distinct()
    idx = global_row_number(classes, col).select(col, (F.col("rn") - 1).alias(out))
    return df.join(idx, col, "left")


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """class, precision, recall, f1, support; plus rows 'accuracy',
    'macro avg' and 'weighted avg' (4 decimals, NULL where undefined)."""
    cm = confusion(df, actual, predicted)
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    pred = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    per = (sup.join(pred, "cls", "full_outer").join(tp, "cls", "left")
           .select("cls", F.coalesce("support", F.lit(0)).alias("support"),
                   F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("tp", F.lit(0)).alias("tp")))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    per = per.select("cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                     F.col("support").cast("bigint").alias("support"), "tp")
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("cls"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").cast("bigint").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"),
                     F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").cast("bigint").alias("support"))
    wei = tot.select(F.lit("weighted avg").alias("cls"), F.col("wp").alias("precision"),
                     F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").cast("bigint").alias("support"))
    allr = per.drop("tp").unionByName(acc).unionByName(mac).unionByName(wei)
    return allr.select(F.col("cls").alias("class"), half_up("precision", 4).alias("precision"),
                       half_up("recall", 4).alias("recall"), half_up("f1", 4).alias("f1"), "support")


def roc_curve(scored: DataFrame, cls: str = "class", label: str = "is_pos", score: str = "score") -> DataFrame:
    """class, threshold, fpr, tpr (one-vs-rest), one point per distinct score
    (descending) plus the origin; running totals are distributed."""
    pts = scored.groupBy(cls, score).agg(
        F.sum(F.col(label).cast("double")).alias("pos"),
        F.sum((1 - F.col(label)).cast("double")).alias("neg"))
    run = running_sums(pts, score, ["pos", "neg"], by=(cls,), ascending=False)
    totals = pts.groupBy(cls).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = run.join(totals, cls)
    curve = j.select(cls, F.col(score).alias("threshold"),
                     F.when(F.col("N") > 0, F.col("run_neg") / F.col("N")).alias("fpr"),
                     F.when(F.col("P") > 0, F.col("run_pos") / F.col("P")).alias("tpr"))
    origin = totals.select(cls, F.lit(None).cast("double").alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(origin)


def roc_auc(scored: DataFrame, cls: str = "class", label: str = "is_pos", score: str = "score") -> DataFrame:
    """Area under each one-vs-rest curve by the rank-sum identity
    AUC = (sum of positive ranks - P(P+1)/2) / (P N), ties ranked on
    average -- equal to the trapezoid area and free of per-class sorting."""
    r = average_rank(scored, score, "_r", by=(cls,))
    g = r.groupBy(cls).agg(
        F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("rs"),
        F.sum(F.col(label).cast("double")).alias("P"),
        F.sum((1 - F.col(label)).cast("double")).alias("N"))
    auc = (F.col("rs") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * F.col("N"))
    return g.select(cls, half_up(F.when((F.col("P") > 0) & (F.col("N") > 0), auc), 4).alias("auc"))


def thin_curve(curve: DataFrame, cls: str = "class", points: int = 50) -> DataFrame:
    """Every max(1, len // points)-th point of each class curve, counted
    along the curve (position from a distributed running count)."""
    c = curve.withColumn("_k", F.coalesce(F.col("fpr"), F.lit(0.0)) + F.coalesce(F.col("tpr"), F.lit(0.0)))
    c = c.withColumn("_one", F.lit(1.0))
    r = running_sums(c, "_k", ["_one"], by=(cls,))
    n = r.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, cls)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return r.where(F.pmod(F.col("run__one").cast("bigint") - 1, step) == 0).drop("_k", "_one", "run__one", "_n")
