"""Global order statistics without a single-task window.

A window with ORDER BY but no PARTITION BY moves every row into one task.
``running_sums`` computes running totals in a global order instead:

1. approximate quantiles of the order key, taken once, cut it into about
   ``spark.sql.shuffle.partitions`` buckets; a row's bucket follows from its
   own key, so every branch of the plan, every retry and every reader agrees;
2. a window per (group, bucket) gives the running totals inside a bucket;
3. the sums of the buckets before it (one row per group and bucket) are
   added through a null-safe join.

Everything else here (average ranks, global row numbers) builds on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS_PER_BUCKET = 64     # distinct string keys looked at per bucket when cuts are chosen


def _axis(df: DataFrame, col: str) -> Column:
    """What buckets are cut on: the key as a number that grows with it (equal numbers share a bucket), strings as they are."""
    kind = df.schema[col].dataType.simpleString()
    c = F.col(col)
    if kind == "string":
        return c
    if kind == "date" or kind.startswith("timestamp"):
        return c.cast("timestamp").cast("double")
    return c.cast("double")


def _cuts(df: DataFrame, axis: Column, text: bool, n: int) -> list:
    """At most n - 1 increasing cut points. They only balance the buckets; results do not depend on them."""
    keys = df.select(axis.alias("a")).where("a IS NOT NULL")
    if not text:
        found = keys.where("NOT isnan(a)").agg(
            F.percentile_approx("a", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"] or []
        return sorted({float(c) for c in found})
    # quantiles of a bounded set of distinct keys, chosen by hash; whole keys, so a common prefix does no harm
    some = keys.distinct().orderBy(F.xxhash64("a"), "a").limit(KEYS_PER_BUCKET * n).collect()
    some = sorted(r.a.encode() for r in some)
    return [c.decode() for c in sorted({some[len(some) * i // n] for i in range(1, n)})] if some else []


def _bucket_of(axis: Column, cuts: list) -> Column:
    """Number of cuts below the key, by two lookups in lists of about the root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c < axis))

    # a group counts as passed when its last cut lies below the key
    group = below(F.array(*[F.lit(g[-1]) for g in groups]))
    lists = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    inside = F.coalesce(F.try_element_at(lists, group + 1), F.array(F.lit(cuts[0])).cast("array<string>" if isinstance(cuts[0], str) else "array<double>"))
    return F.when(group < len(groups), group * width + below(inside)).otherwise(F.lit(len(cuts)))


def _same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_r_{c}"]) for c in cols])


def _join_null_safe(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    return left.join(renamed, _same(left, renamed, cols), how).drop(*[f"_r_{c}" for c in cols])


def running_sums(df: DataFrame, order: str, cols: list[str], by: tuple = (),
                 ascending: bool = True, out_prefix: str = "run_") -> DataFrame:
    """Adds ``run_<c>`` = sum of ``c`` over rows up to and including this
    one, in ``order`` (within each ``by`` group). NULLs in ``c`` count as 0;
    a NULL key or group is a value of its own (NULL keys come first, or last
    when descending). Ties of ``order`` are ordered arbitrarily; aggregate to
    distinct order values first when ties must share a total. Taking the
    quantiles is one small job at call time."""
    by = list(by)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    axis = _axis(df, order)
    cuts = _cuts(df, axis, df.schema[order].dataType.simpleString() == "string", n)
    bucket = F.when(axis.isNull(), -1).otherwise(_bucket_of(axis, cuts))
    d = df.withColumn("_bucket", bucket.cast("int"))
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    turn = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    inside = Window.partitionBy(*by, "_bucket").orderBy(turn(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    run = d.withColumns({f"_loc_{c}": F.sum(value[c]).over(inside) for c in cols})
    # one row per group and bucket
    before = Window.partitionBy(*by).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*by, "_bucket").agg(*[F.sum(value[c]).alias(f"_sum_{c}") for c in cols])
    offsets = sums.select(*by, "_bucket", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0.0)).alias(f"_off_{c}")
                                           for c in cols])
    j = _join_null_safe(run, offsets, [*by, "_bucket"])
    return j.select(*df.columns, *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"{out_prefix}{c}")
                                   for c in cols])


def average_rank(df: DataFrame, col: str, out: str, by: tuple = ()) -> DataFrame:
    """Fractional rank (ties share the mean of their positions), 1-based.
    Rows without a value keep their place in the result with a NULL rank."""
    by = list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    runs = running_sums(counts, col, ["_c"], by=tuple(by))
    ranks = runs.select(*by, col, (F.col("run__c") - F.col("_c") + (F.col("_c") + 1) / 2).alias(out))
    return _join_null_safe(df, ranks, [*by, col], "left")


def global_row_number(df: DataFrame, order: str, out: str = "rn") -> DataFrame:
    """1-based position in ``order`` (the order key must be unique)."""
    r = running_sums(df.withColumn("_one", F.lit(1.0)), order, ["_one"])
    return r.withColumn(out, F.col("run__one").cast("bigint")).drop("_one", "run__one")
