"""One-way ANOVA, effect size and Spearman correlation as aggregates.

Sums of squares come from a per-group aggregate and a grand aggregate
(one row each per group: bounded by the number of groups), so the data
is read once. Spearman is Pearson ``corr`` over average ranks computed
with the distributed ranking of ``ranking.average_rank``.

p-values are the regularised incomplete beta function of the statistic, an
expression on the one result row; no further pass over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.expr import (
    beta_tail, correlation_sign, correlation_strength, effect_size_label, f_tail, half_up,
)
from ledgerscope.operators.ranking import average_rank


def p_round(p: Column | str) -> Column:
    """3 significant digits below 0.01, else 6 decimals; 0 stays 0."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 1e-300, p).when(p < 0.01, F.format_string("%.2e", p).cast("double")).otherwise(half_up(p, 6))


def anova_oneway(df: DataFrame, value: str, group: str, scale: int = 2) -> DataFrame:
    """k, n, df_between, df_within, f_statistic, eta_squared, effect_size.

    One pass: per group n, sum x and sum x^2 (summed exactly as decimals
    of ``scale`` places), then the sums of squares in closed form over the
    group rows (one per group: a bounded, tiny table):
      SSW = sum_g (S2_g - S1_g^2 / n_g)   SSB = sum_g S1_g^2 / n_g - S1^2 / N
    """
    x = F.col(value).cast(f"decimal(18,{scale})")
    g = df.groupBy(group).agg(
        F.count(value).alias("n_g"),
        F.sum(x).cast("double").alias("s1"),
        F.sum(x * x).cast("double").alias("s2"))
    r = g.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_g").alias("n"),
        F.sum(F.col("s1") * F.col("s1") / F.col("n_g")).alias("between_raw"),
        F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    n = F.col("n").cast("double")
    ssb = F.col("between_raw") - F.col("s1") * F.col("s1") / n
    ssw = F.col("s2") - F.col("between_raw")
    sst = F.col("s2") - F.col("s1") * F.col("s1") / n
    dfb = F.col("k") - 1
    dfw = F.col("n") - F.col("k")
    fstat = F.try_divide(F.try_divide(ssb, dfb), F.try_divide(ssw, dfw))
    eta = F.when(sst > 0, ssb / sst).otherwise(F.lit(0.0))
    return r.select(F.col("k").cast("bigint").alias("k"), F.col("n").cast("bigint").alias("n"),
                    dfb.cast("bigint").alias("df_between"), dfw.cast("bigint").alias("df_within"),
                    half_up(fstat, 4).alias("f_statistic"), fstat.alias("_f"),
                    half_up(eta, 4).alias("eta_squared"),
                    effect_size_label(eta).alias("effect_size"))


def with_anova_pvalue(a: DataFrame) -> DataFrame:
    """Adds p_value and significant (below 0.05) to ``anova_oneway``: the tail of F, an expression on its one row."""
    p = f_tail("_f", "df_between", "df_within")
    return a.withColumn("_p", p).withColumn("p_value", p_round("_p")).withColumn("significant", F.col("_p") < 0.05).drop("_p")


def _ranked(df: DataFrame, x: str, y: str) -> DataFrame:
    """Average ranks of the rows that have both values."""
    both = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_rank(average_rank(both, x, "_rx"), y, "_ry")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho on average ranks, rounded to 4; strength / sign words."""
    c = _ranked(df, x, y).agg(F.corr("_rx", "_ry").alias("_rho"), F.count(F.lit(1)).alias("n"))
    return c.select(half_up("_rho", 4).alias("rho"), "_rho", F.col("n").cast("bigint").alias("n"),
                    correlation_strength("_rho").alias("strength"),
                    correlation_sign("_rho").alias("direction"),
                    (F.abs("_rho") > 0.3).alias("captures_liquidity"))


def with_spearman_pvalue(s: DataFrame) -> DataFrame:
    """Adds p_value and significant to ``spearman``: the two-sided tail of t with n - 2 degrees of freedom."""
    df = F.col("n").cast("double") - 2
    p = F.when(df > 0, beta_tail(1 - F.col("_rho") * F.col("_rho"), df / 2, F.lit(0.5)))
    return s.withColumn("_p", p).withColumn("p_value", p_round("_p")).withColumn("significant", F.col("_p") < 0.05).drop("_p")
