"""Parameters of the scoring, windowing, forecasting and alerting rules.

FIXED VALUES: the defaults below must equal the reference behaviour for
results to match (score weights, normalisers, cut-offs, window sizes,
horizons). They are grouped here, in natural order, and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RiskParams:
    # --- fixed values: composite score ---
    w_trend: float = 0.4
    w_regularity: float = 0.3
    w_volatility: float = 0.2
    w_debt: float = 0.1
    trend_offset: float = 500.0          # slope + 500, divided by 10
    trend_divisor: float = 10.0
    regularity_decay: float = 1.2        # 100 * exp(-cv / 1.2)
    volatility_decay: float = 0.06       # 100 * exp(-rel_vol / 0.06)
    debt_factor: float = 200.0           # 100 - 200 * share of negative days
    eps: float = 1e-9
    neutral_score: float = 50.0          # score when no delta / diff exists
    regularity_min_rows: int = 60        # cut-off applies only above 60 rows
    regularity_cutoff_days: int = 30     # keep dates < max(date) - 30 days

    # --- fixed values: labels ---
    red_below: float = 35.0              # < 35 RED
    amber_below: float = 60.0            # < 60 AMBER, else GREEN
    tier_high_below: float = 60.0        # < 60 High
    tier_medium_below: float = 75.0      # < 75 Medium, else Low

    # --- fixed values: stress shock ---
    shock_days: int = 30                 # date >= max(date) - 30 days (31 days)

    # --- fixed values: hopping windows over rows (features) ---
    hop_size: int = 180
    hop_step: int = 30
    hop_min_rows: int = 90

    # --- fixed values: rolling daily series (forecast input) ---
    lookback_days: int = 45
    rolling_days: int = 180              # window [end - 180 d, end], 181 rows

    # --- fixed values: forecast ---
    horizon: int = 30
    z: float = 1.96
    resid_floor: float = 0.5             # residual std below 0.5 ...
    resid_default: float = 2.0           # ... or missing becomes 2.0
    linear_tail: int = 30                # OLS / slope over the last 30 points
    sma_window: int = 7
    train_share: float = 0.8
    backtest_min_points: int = 10
    backtest_min_test: int = 3
    holt_grid_step: float = 0.05         # alpha, beta in {0.05, 0.10, ..., 1.0}

    # --- fixed values: alerts ---
    alert_floor: float = 35.0            # min yhat_lower < 35 -> CRITICAL
    decline_margin: float = 1.0          # last yhat < first yhat - 1.0

    # --- fixed values: model evaluation ---
    leakage_accuracy: float = 0.97
    feature_columns: tuple = field(default=(
        "bal_mean", "bal_std", "bal_trend", "bal_cv",
        "fhs_std", "income_regularity",
        "vel_mean", "vel_max",
        "pct_negative_days", "max_drawdown", "runway_mean",
    ))


DEFAULT_PARAMS = RiskParams()
