"""Scalar column expressions shared by all operators.

Rounding: ``half_up(x, n) = floor(x * 10^n + 0.5) / 10^n``. It is written
with plain IEEE-double arithmetic so that Spark and any SQL engine give the
same bits (Spark's ``round`` goes through the decimal string of a double,
other engines scale and round; they disagree on values such as 0.285).

Clipping keeps NULL as NULL: ``least``/``greatest`` skip NULLs, which would
turn a missing score into a perfect one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope.params import DEFAULT_PARAMS, RiskParams


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x, n: int) -> Column:
    scale = float(10 ** n)
    x = _c(x)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def exact_avg(x, scale: int = 2) -> Column:
    """Mean of values that carry ``scale`` decimals, summed exactly.

    sum(decimal) is exact in every engine, so the mean (one double
    division) no longer depends on summation order; this matters when the
    mean is rounded and can land on a rounding boundary.
    """
    x = _c(x)
    total = F.sum(x.cast(f"decimal(18,{scale})")).cast("double")
    return total / F.count(x)


def share_pct(cond) -> Column:
    """100 * (rows where cond) / rows."""
    return F.lit(100.0) * F.count_if(cond) / F.count(F.lit(1))


def clip(x, lo: float = 0.0, hi: float = 100.0) -> Column:
    x = _c(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def safe_div(num, den) -> Column:
    return F.try_divide(_c(num), _c(den))


def exp_decay(x, scale: float) -> Column:
    """clip(100 * exp(-x / scale), 0, 100); NULL stays NULL."""
    x = _c(x)
    return clip(F.lit(100.0) * F.exp(-x / F.lit(float(scale))))


# ---- labels -------------------------------------------------------------

def risk_label(x, p: RiskParams = DEFAULT_PARAMS) -> Column:
    """RED / AMBER / GREEN on the unrounded score; NULL stays NULL."""
    x = _c(x)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x < p.red_below, "RED")
            .when(x < p.amber_below, "AMBER")
            .otherwise("GREEN"))


def risk_word(label) -> Column:
    label = _c(label)
    return (F.when(label == "RED", "CRITICAL")
            .when(label == "AMBER", "AT-RISK")
            .when(label == "GREEN", "HEALTHY"))


def risk_word_title(label) -> Column:
    label = _c(label)
    return (F.when(label == "RED", "Critical")
            .when(label == "AMBER", "At-Risk")
            .when(label == "GREEN", "Healthy"))


def score_badge(x, p: RiskParams = DEFAULT_PARAMS) -> Column:
    x = _c(x)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x < p.red_below, "score-red")
            .when(x < p.amber_below, "score-amber")
            .otherwise("score-green"))


def risk_tier(x, p: RiskParams = DEFAULT_PARAMS) -> Column:
    x = _c(x)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x < p.tier_high_below, "High")
            .when(x < p.tier_medium_below, "Medium")
            .otherwise("Low"))


def shock_band(shock) -> Column:
    s = _c(shock)
    return (F.when(s <= 0, "none")
            .when(s <= 15, "mild")
            .when(s <= 30, "substantial")
            .otherwise("severe"))


def effect_size_label(eta2) -> Column:
    e = _c(eta2)
    return F.when(e > 0.14, "large").when(e > 0.06, "medium").otherwise("small")


def correlation_strength(rho) -> Column:
    r = F.abs(_c(rho))
    return F.when(r > 0.7, "Strong").when(r > 0.4, "Moderate").otherwise("Weak")


def correlation_sign(rho) -> Column:
    return F.when(_c(rho) > 0, "positive").otherwise("negative")


# ---- distribution tails ---------------------------------------------------

# fixed values: Lanczos coefficients of log gamma (g = 7, 9 terms)
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(z) -> Column:
    """ln of the gamma function for z >= 0.5."""
    x = _c(z) - 1
    total = F.lit(LANCZOS[0])
    for k, v in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(v) / (x + k)
    t = x + 7.5
    return F.lit(0.9189385332046727) + (x + 0.5) * F.log(t) - t + F.log(total)


def beta_tail(x, a, b) -> Column:
    """Regularised incomplete beta function I_x(a, b), a and b of 0.5 or more.

    The continued fraction is evaluated by Lentz's method on the side where it converges
    fast; the number of terms grows with the root of the larger parameter.
    """
    x, a, b = _c(x).cast("double"), _c(a).cast("double"), _c(b).cast("double")
    direct = x < (a + 1) / (a + b + 2)
    start = F.struct(F.when(direct, a).otherwise(b).alias("a"), F.when(direct, b).otherwise(a).alias("b"),
                     F.when(direct, x).otherwise(1 - x).alias("x"))

    def sound(v):
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def fraction(s):
        a, b, x = s["a"], s["b"], s["x"]
        first = 1 / sound(1 - (a + b) * x / (a + 1))
        terms = F.sequence(F.lit(1), (F.lit(200) + F.ceil(4 * F.sqrt(F.greatest(a, b)))).cast("int"))

        def turn(acc, up):
            d, c = 1 / sound(1 + up * acc["d"]), sound(1 + up / acc["c"])
            return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

        def step(acc, m):
            # both halves of a term, each on its own struct, so that nothing is computed twice
            return F.aggregate(F.array(m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)),
                                       -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))), acc, turn)

        return F.aggregate(F.transform(terms, lambda m: m.cast("double")),
                           F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step)["h"]

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    part = front * fraction(start) / F.when(direct, a).otherwise(b)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(F.when(direct, part).otherwise(1 - part))


def f_tail(f, d1, d2) -> Column:
    """P(F > f) of the F distribution with (d1, d2) degrees of freedom."""
    f, d1, d2 = _c(f), _c(d1).cast("double"), _c(d2).cast("double")
    return beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)
