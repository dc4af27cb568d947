"""Dimension lookups (recommended actions, explanations) and text columns.

The texts belong to this library: what a bank may do next for a market
segment of the supplied customer table at each risk tier, and why a
segment's score may sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# (segment, tier) -> action
ACTIONS = [
    ("AUTOMOBILE", "RED", "Call within two days and stretch the car loan over more instalments."),
    ("AUTOMOBILE", "AMBER", "Ask about upcoming repairs and set money aside for them."),
    ("AUTOMOBILE", "GREEN", "Mention the leasing rates when the next car is due."),
    ("BUILDING", "RED", "Visit the site office and agree which supplier invoices can wait."),
    ("BUILDING", "AMBER", "Compare the payment plan with the progress of the works."),
    ("BUILDING", "GREEN", "Propose a limit for the next construction phase."),
    ("FURNITURE", "RED", "Pause the standing orders and go through the open invoices together."),
    ("FURNITURE", "AMBER", "Move the larger bills to the months after the fairs."),
    ("FURNITURE", "GREEN", "Suggest a discount account for early supplier payment."),
    ("HOUSEHOLD", "RED", "Invite to debt counselling and waive fees while it lasts."),
    ("HOUSEHOLD", "AMBER", "Send a weekly overview of fixed costs."),
    ("HOUSEHOLD", "GREEN", "Point to term deposits for the surplus."),
    ("MACHINERY", "RED", "Have the machines valued and turn short debt into a long loan."),
    ("MACHINERY", "AMBER", "Match the lease dates to the dates of the order book."),
    ("MACHINERY", "GREEN", "Prepare an offer for the replacement of older machines."),
]
DEFAULT_ACTION = "No rule for this pair; leave it to the account manager."

# segment -> explanation
EXPLANATIONS = [
    ("AUTOMOBILE", "Fuel, insurance and repairs fall into the same weeks. Spreading them out would lift the low points."),
    ("BUILDING", "Material is paid long before the client pays. An advance on each milestone would close the distance."),
    ("FURNITURE", "Most revenue comes in two quarters of the year. The other two live on what was put aside."),
    ("HOUSEHOLD", "Rent and card bills leave the account before wages arrive. Later due dates would keep it above zero."),
    ("MACHINERY", "One machine costs as much as months of income. Paying in steps would keep cash in hand."),
]
DEFAULT_EXPLANATION = "Balances of %s weaken over the forecast; someone should look at the accounts behind it."


def action_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTIONS, "segment string, tier string, action string")


def explanation_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPLANATIONS, "segment string, explanation string")


def action_lookup(df: DataFrame, tier_col: str = "tier") -> DataFrame:
    """Left join on (segment, tier); unknown pairs get the default text.
    The dimension is a fixed 15-row table, so it is broadcast."""
    dim = F.broadcast(action_dim(df.sparkSession)).withColumnRenamed("tier", "_tier")
    j = df.join(dim, (df["segment"] == dim["segment"]) & (F.col(tier_col) == F.col("_tier")), "left")
    return j.select(df["*"], F.coalesce(dim["action"], F.lit(DEFAULT_ACTION)).alias("recommended_action"))


def alert_tier(alerts: DataFrame) -> DataFrame:
    """CRITICAL alerts take the RED action, all others the AMBER one."""
    return alerts.withColumn("action_tier", F.when(F.col("severity") == "CRITICAL", "RED").otherwise("AMBER"))


def fallback_explanation(df: DataFrame) -> DataFrame:
    dim = F.broadcast(explanation_dim(df.sparkSession)).withColumnRenamed("segment", "_seg")
    j = df.join(dim, df["segment"] == dim["_seg"], "left")
    return j.select(df["*"], F.coalesce(F.col("explanation"),
                                        F.format_string(DEFAULT_EXPLANATION, df["segment"])).alias("explanation"))


def first_nonblank(*cols) -> F.Column:
    """First candidate that is not NULL or blank, in priority order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, c) for c in cols])


def prompt_text(alerts: DataFrame) -> DataFrame:
    fmt = ("Segment: %s | Health score day 1: %.1f / 100 | day 30: %.1f / 100 | "
           "worst-case lower bound: %.1f / 100 | severity: %s | declining: %s")
    return alerts.select("segment", F.format_string(
        fmt, "segment", "fhs_day1", "fhs_day30", "min_lower", "severity",
        F.col("declining").cast("string")).alias("prompt"))


def sentences(df: DataFrame, text: str = "explanation", key: str = "segment") -> DataFrame:
    """Split after a full stop followed by one whitespace; trim; drop
    pieces of 3 characters or fewer; keep the position (1-based)."""
    parts = F.split(F.regexp_replace(F.col(text), r"\.\s", ".\u0001"), "\u0001")
    kept = F.filter(parts, lambda s: F.length(F.trim(s)) > 3)
    return df.select(key, F.posexplode(kept).alias("pos", "sentence")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("pos"), F.trim("sentence").alias("sentence"))
