"""Column-expression helpers (pure pyspark.sql.functions, JVM side)."""

from ledgerscope.functions.expr import (
    half_up, exact_avg, share_pct, clip, safe_div, exp_decay,
    risk_label, risk_word, risk_word_title, score_badge, risk_tier,
    shock_band, effect_size_label, correlation_strength, correlation_sign,
)

__all__ = [
    "half_up", "exact_avg", "share_pct", "clip", "safe_div", "exp_decay",
    "risk_label", "risk_word", "risk_word_title", "score_badge", "risk_tier",
    "shock_band", "effect_size_label", "correlation_strength", "correlation_sign",
]
