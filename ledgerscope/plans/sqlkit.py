"""ANSI-SQL text for the DuckDB cross-check (oracle side of each query).

These strings restate the definitions of the Spark operators in plain SQL
over the supplied tables: a dense calendar joined to daily flows with a
running sum, brute-force window ranges, and so on. They are written the
naive way on purpose, so that the Spark plan is checked against a
different formulation of the same result.
"""

from __future__ import annotations

from ledgerscope.params import DEFAULT_PARAMS as P
from ledgerscope.sources.ledger import LINE_SIGN, ORDER_SIGN


def hu(x: str, n: int) -> str:
    s = f"{float(10 ** n)!r}"
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def exact_avg(x: str, scale: int = 2) -> str:
    return f"(CAST(sum(CAST(({x}) AS DECIMAL(18,{scale}))) AS DOUBLE) / count({x}))"


def share_pct(cond: str) -> str:
    return f"(100.0 * count_if({cond}) / count(*))"


def clip(x: str, lo: float = 0.0, hi: float = 100.0) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest(({x}), {lo!r}), {hi!r}) END)"


def decay(x: str, scale: float) -> str:
    return clip(f"100.0 * exp(-({x}) / {scale!r})")


def risk_label(x: str) -> str:
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < {P.red_below!r} THEN 'RED' "
            f"WHEN ({x}) < {P.amber_below!r} THEN 'AMBER' ELSE 'GREEN' END)")


def risk_tier(x: str) -> str:
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < {P.tier_high_below!r} THEN 'High' "
            f"WHEN ({x}) < {P.tier_medium_below!r} THEN 'Medium' ELSE 'Low' END)")


def with_(*ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(c.strip() for c in ctes if c) + "\n"


# ---- ledgers and panel -----------------------------------------------------

def flows_cte(ledger: str = "lines", name: str = "flows") -> str:
    if ledger == "lines":
        return f"""{name} AS (
  SELECT CAST(o.o_custkey AS BIGINT) AS customer_id, CAST(l.l_shipdate AS DATE) AS d,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) *
              (CAST(1 AS DECIMAL(3,2)) - CAST(l.l_discount AS DECIMAL(3,2))) *
              CAST(CASE l.l_returnflag WHEN 'R' THEN {LINE_SIGN['R']!r} WHEN 'A' THEN {LINE_SIGN['A']!r}
                   ELSE {LINE_SIGN['N']!r} END AS DECIMAL(2,1)) AS DECIMAL(18,5)) AS amount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
    if ledger == "orders":
        return f"""{name} AS (
  SELECT CAST(o_custkey AS BIGINT) AS customer_id, CAST(o_orderdate AS DATE) AS d,
         CAST(CAST(o_totalprice AS DECIMAL(15,2)) *
              CAST(CASE o_orderstatus WHEN 'F' THEN {ORDER_SIGN['F']!r} ELSE {ORDER_SIGN['O']!r} END
                   AS DECIMAL(2,1)) AS DECIMAL(18,5)) AS amount
  FROM orders WHERE o_orderstatus IN ('F', 'O'))"""
    raise ValueError(ledger)


def panel_ctes(ledger: str = "lines", name: str = "panel") -> list[str]:
    """CTEs flows, bounds, cal, pre, daily, <name>: complete daily balances."""
    return [
        flows_cte(ledger),
        ("bounds AS (SELECT min(CAST(l_shipdate AS DATE)) AS d_start, "
         "max(CAST(l_shipdate AS DATE)) AS d_end FROM lineitem)" if ledger == "lines" else
         "bounds AS (SELECT min(d) AS d_start, max(d) AS d_end FROM flows)"),
        """cal AS (SELECT CAST(d_start + CAST(i AS INTEGER) AS DATE) AS date
  FROM (SELECT d_start, unnest(range(0, date_diff('day', d_start, d_end) + 1)) AS i FROM bounds))""",
        """pre AS (SELECT f.customer_id, sum(f.amount) AS amt FROM flows f, bounds b
         WHERE f.d < b.d_start GROUP BY f.customer_id)""",
        """daily AS (SELECT f.customer_id, f.d, sum(f.amount) AS net FROM flows f, bounds b
           WHERE f.d >= b.d_start GROUP BY f.customer_id, f.d)""",
        f"""{name} AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS customer_id, c.c_mktsegment AS segment, cal.date,
    CAST(round(CAST(c.c_acctbal AS DECIMAL(15,2)) + coalesce(p.amt, 0)
       + sum(coalesce(dl.net, 0)) OVER (PARTITION BY c.c_custkey ORDER BY cal.date
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE) AS balance
  FROM customer c CROSS JOIN cal
  LEFT JOIN pre p ON p.customer_id = c.c_custkey
  LEFT JOIN daily dl ON dl.customer_id = c.c_custkey AND dl.d = cal.date)""",
    ]


# ---- per-series scores -------------------------------------------------------

def score_ctes(src: str = "panel", keys: str = "customer_id, segment",
               series: str = "customer_id", name: str = "scores") -> list[str]:
    """CTEs <name>_mom, <name>_cut, <name>_closes, <name>_deltas, <name>_reg, <name>."""
    k = [x.strip() for x in keys.split(",")]
    s = [x.strip() for x in series.split(",")]
    join_on = " AND ".join(f"m.{c} = r.{c}" for c in s)
    return [
        f"""{name}_pd AS (SELECT {keys}, date, balance,
   balance - lag(balance) OVER (PARTITION BY {series} ORDER BY date) AS diff FROM {src})""",
        f"""{name}_mom AS (SELECT {keys}, count(*) AS n,
   regr_slope(balance, CAST(date - DATE '1970-01-01' AS DOUBLE)) AS slope,
   stddev_samp(diff) AS diff_std, count(diff) AS n_diff, avg(balance) AS bal_mean,
   avg(CASE WHEN balance < 0 THEN 1.0 ELSE 0.0 END) AS pct_negative
  FROM {name}_pd GROUP BY {keys})""",
        f"""{name}_cut AS (SELECT {series}, date, balance,
   count(*) OVER (PARTITION BY {series}) AS _n, max(date) OVER (PARTITION BY {series}) AS _dmax FROM {src})""",
        f"""{name}_closes AS (SELECT {series}, CAST(date_trunc('month', date) AS DATE) AS month,
   arg_max(balance, date) AS close FROM {name}_cut
   WHERE _n <= {P.regularity_min_rows} OR date < _dmax - {P.regularity_cutoff_days}
   GROUP BY {series}, CAST(date_trunc('month', date) AS DATE))""",
        f"""{name}_deltas AS (SELECT {series}, month,
   CASE WHEN date_diff('month', lag(month) OVER (PARTITION BY {series} ORDER BY month), month) = 1
        THEN close - lag(close) OVER (PARTITION BY {series} ORDER BY month) END AS delta
  FROM {name}_closes)""",
        f"""{name}_reg AS (SELECT {series}, count(delta) AS n_delta, stddev_samp(delta) AS delta_std,
   avg(delta) AS delta_mean FROM {name}_deltas WHERE delta IS NOT NULL GROUP BY {series})""",
        f"""{name}_parts AS (SELECT {', '.join('m.' + c for c in k)},
   {hu(clip('(m.slope + 500.0) / 10.0'), 2)} AS balance_trend,
   CASE WHEN coalesce(r.n_delta, 0) = 0 THEN 50.0
        ELSE {hu(decay('r.delta_std / (abs(r.delta_mean) + 1e-9)', P.regularity_decay), 2)} END AS income_regularity,
   CASE WHEN m.n_diff = 0 THEN 50.0
        ELSE {hu(decay('m.diff_std / (abs(m.bal_mean) + 1e-9)', P.volatility_decay), 2)} END AS spending_volatility,
   {hu(clip('100.0 - 200.0 * m.pct_negative'), 2)} AS debt_ratio
  FROM {name}_mom m LEFT JOIN {name}_reg r ON {join_on})""",
        f"""{name} AS (SELECT *,
   {hu(clip(COMPOSITE), 2)} AS fhs, {COMPOSITE} AS fhs_raw FROM {name}_parts)""",
    ]


COMPOSITE = ("0.4 * balance_trend + 0.3 * income_regularity + 0.2 * spending_volatility"
             " + 0.1 * debt_ratio")

PARTS = ("balance_trend", "income_regularity", "spending_volatility", "debt_ratio")


def heatmap_cte(src: str = "scores", keys: str = "segment", name: str = "heatmap") -> str:
    parts = ",\n   ".join(f"{hu(exact_avg(c), 1)} AS {c}" for c in PARTS)
    return f"""{name} AS (SELECT {keys}, {hu(exact_avg('fhs_raw', 3), 2)} AS fhs,
   {risk_label(exact_avg('fhs_raw', 3))} AS risk_label,
   {parts}
  FROM {src} GROUP BY {keys})"""


# ---- features ----------------------------------------------------------------

HOP_WIN = [
    """ipanel AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY date) - 1 AS idx,
   count(*) OVER (PARTITION BY customer_id) AS n FROM panel)""",
    "starts AS (SELECT CAST(s * 30 AS BIGINT) AS win_start FROM (SELECT unnest(range(0, max(n) // 30 + 1)) AS s FROM ipanel))",
    """hwin AS (SELECT p.customer_id, st.win_start, p.segment, p.date, p.balance
  FROM ipanel p JOIN starts st
    ON st.win_start < greatest(1, p.n - 180) AND p.idx >= st.win_start AND p.idx < st.win_start + 180)""",
]


def feature_ctes() -> list[str]:
    """CTEs fb (balance moments), freg (raw regularity), fh (window FHS),
    features (the rounded feature table) over ``panel``."""
    return [
        """fp AS (SELECT customer_id, segment, date, balance,
   balance - lag(balance) OVER (PARTITION BY customer_id ORDER BY date) AS diff,
   max(balance) OVER (PARTITION BY customer_id ORDER BY date
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS runmax FROM panel)""",
        f"""fb AS (SELECT customer_id, segment, count(*) AS n, {exact_avg('balance')} AS bal_mean,
   stddev_pop(balance) AS bal_std,
   regr_slope(balance, CAST(date - DATE '1970-01-01' AS DOUBLE)) AS bal_trend,
   {exact_avg('abs(diff)')} AS vel_mean, max(abs(diff)) AS vel_max,
   avg(CASE WHEN balance < 0 THEN 1.0 ELSE 0.0 END) AS pct_negative_days,
   max(runmax - balance) AS max_drawdown,
   {exact_avg('CASE WHEN diff < 0 THEN -diff END')} AS avg_expense
  FROM fp GROUP BY customer_id, segment)""",
        """fcl AS (SELECT customer_id, CAST(date_trunc('month', date) AS DATE) AS month,
   arg_max(balance, date) AS close FROM panel GROUP BY customer_id, CAST(date_trunc('month', date) AS DATE))""",
        """fdl AS (SELECT customer_id, month,
   CASE WHEN date_diff('month', lag(month) OVER (PARTITION BY customer_id ORDER BY month), month) = 1
        THEN close - lag(close) OVER (PARTITION BY customer_id ORDER BY month) END AS delta FROM fcl)""",
        """freg AS (SELECT customer_id, count(delta) AS n_delta,
   CASE WHEN count(delta) > 1 THEN stddev_samp(delta) / (abs(avg(delta)) + 1e-9) ELSE 1.0 END
     AS income_regularity
  FROM fdl WHERE delta IS NOT NULL GROUP BY customer_id)""",
        *HOP_WIN,
        *score_ctes("hwin", keys="customer_id, win_start, segment",
                    series="customer_id, win_start", name="hs"),
        f"""fh AS (SELECT customer_id, {exact_avg('fhs')} AS fhs_mean, count(*) AS n_windows,
   CASE WHEN count(*) > 1 THEN stddev_pop(fhs) ELSE 0.0 END AS fhs_std FROM hs GROUP BY customer_id)""",
        f"""features AS (SELECT b.customer_id, b.segment,
   {hu('b.bal_mean', 2)} AS bal_mean, {hu('b.bal_std', 2)} AS bal_std,
   {hu('b.bal_trend', 4)} AS bal_trend,
   {hu('b.bal_std / (abs(b.bal_mean) + 1e-9)', 4)} AS bal_cv,
   {hu('h.fhs_std', 4)} AS fhs_std,
   {hu('coalesce(r.income_regularity, 1.0)', 4)} AS income_regularity,
   {hu('b.vel_mean', 2)} AS vel_mean, {hu('b.vel_max', 2)} AS vel_max,
   {hu('b.pct_negative_days', 4)} AS pct_negative_days,
   {hu('b.max_drawdown', 2)} AS max_drawdown,
   {hu(clip('b.bal_mean / (coalesce(b.avg_expense, 1.0) + 1e-9)', 0.0, 365.0), 2)} AS runway_mean,
   {risk_tier('h.fhs_mean')} AS risk_tier,
   {hu('h.fhs_mean', 2)} AS _fhs_mean
  FROM fb b LEFT JOIN freg r ON r.customer_id = b.customer_id
            LEFT JOIN fh h ON h.customer_id = b.customer_id)""",
    ]


# ---- forecasting -------------------------------------------------------------

def grid_cte(k: int = 20) -> str:
    return (f"grid AS (SELECT CAST(a.i AS DOUBLE) / {float(k)!r} AS alpha, "
            f"CAST(b.j AS DOUBLE) / {float(k)!r} AS beta FROM range(1, {k + 1}) a(i), range(1, {k + 1}) b(j))")


def holt_ctes(src: str, name: str, refine: int = 10, k: int = 400) -> list[str]:
    """Recursive Holt fold per (segment, alpha, beta) over ``src``
    (segment, t, value, n) on the coarse grid, then on a fine grid of 1/k
    steps around its optimum; ``<name>_best`` keeps the least-SSE pair."""
    return [
        *_holt_stage(src, f"{name}_c", "grid"),
        f"""{name}_fgrid AS (SELECT c.segment, c.alpha + CAST(i.i AS DOUBLE) / {float(k)!r} AS alpha,
   c.beta + CAST(j.j AS DOUBLE) / {float(k)!r} AS beta
  FROM {name}_c_best c, range(-{refine}, {refine + 1}) i(i), range(-{refine}, {refine + 1}) j(j)
  WHERE c.alpha + CAST(i.i AS DOUBLE) / {float(k)!r} > 0 AND c.alpha + CAST(i.i AS DOUBLE) / {float(k)!r} <= 1
    AND c.beta + CAST(j.j AS DOUBLE) / {float(k)!r} > 0 AND c.beta + CAST(j.j AS DOUBLE) / {float(k)!r} <= 1)""",
        *_holt_stage(src, name, f"{name}_fgrid", per_segment=True),
    ]


def _holt_stage(src: str, name: str, grid: str, per_segment: bool = False) -> list[str]:
    """Recursive fold of the state's coefficients in the start values; the best
    start of each pair from the normal equations."""
    on = " AND g.segment = s1.segment" if per_segment else ""
    f = "(h.lc + h.bc)", "(h.lu + h.bu)", "(h.lv + h.bv)"
    keep, hold = "(1.0 - h.alpha)", "(1.0 - h.beta)"
    lc, lu, lv = f"(h.alpha * (y.value - h.y1) + {keep} * {f[0]})", f"({keep} * {f[1]})", f"({keep} * {f[2]})"
    e = f"(y.value - h.y1 - {f[0]})"
    return [
        f"""{name}(segment, alpha, beta, t, y1, lc, lu, lv, bc, bu, bv, cc, cu, cv, uu, uv, vv) AS (
  SELECT s1.segment, g.alpha, g.beta, CAST(0 AS BIGINT), s1.value, {", ".join(f"CAST({x} AS DOUBLE)" for x in (0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0))}
  FROM {src} s1 JOIN {grid} g ON s1.t = 1 AND s1.n >= 3{on}
  UNION ALL
  SELECT h.segment, h.alpha, h.beta, h.t + 1, h.y1, {lc}, {lu}, {lv},
    h.beta * ({lc} - h.lc) + {hold} * h.bc, h.beta * ({lu} - h.lu) + {hold} * h.bu, h.beta * ({lv} - h.lv) + {hold} * h.bv,
    h.cc + {e} * {e}, h.cu + {e} * {f[1]}, h.cv + {e} * {f[2]},
    h.uu + {f[1]} * {f[1]}, h.uv + {f[1]} * {f[2]}, h.vv + {f[2]} * {f[2]}
  FROM {name} h JOIN {src} y ON y.segment = h.segment AND y.t = h.t + 1)""",
        f"""{name}_start AS (SELECT h.*, h.uu * h.vv - h.uv * h.uv AS det, s.value - h.y1 AS rise
  FROM {name} h JOIN {src} s ON s.segment = h.segment AND s.t = 2 AND h.t = s.n)""",
        f"""{name}_fit AS (SELECT *,
   CASE WHEN det > 1e-12 * uu * vv THEN (cu * vv - cv * uv) / det ELSE -rise END AS l0,
   CASE WHEN det > 1e-12 * uu * vv THEN (cv * uu - cu * uv) / det ELSE rise END AS b0 FROM {name}_start)""",
        f"""{name}_best AS (SELECT segment, alpha, beta, y1 + lc + lu * l0 + lv * b0 AS level, bc + bu * l0 + bv * b0 AS trend, sse FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY sse, alpha, beta) AS rk FROM (
    SELECT *, greatest(cc - 2.0 * (l0 * cu + b0 * cv) + l0 * l0 * uu + 2.0 * l0 * b0 * uv + b0 * b0 * vv, 0.0) AS sse FROM {name}_fit))
  WHERE rk = 1)""",
    ]


GOLDEN, GOLDEN_STEPS = repr((5 ** 0.5 - 1) / 2), 18


def _ses_fold(alpha: str) -> str:
    """The state's and errors' coefficients in the start level after the list ``ys`` (relative to ``y1``)."""
    fields = ("v", "lc", "lu", "cc", "cu", "uu", "c", "u")

    def pack(*values: str) -> str:
        return "{" + ", ".join(f"'{f}': {v}" for f, v in zip(fields, values)) + "}"

    zero = "CAST(0 AS DOUBLE)"
    start = pack(zero, zero, "CAST(1 AS DOUBLE)", *[zero] * 5)
    e = "(x.v - y1 - s.lc)"
    step = pack("x.v", f"({alpha}) * (x.v - y1) + (1.0 - ({alpha})) * s.lc", f"(1.0 - ({alpha})) * s.lu", f"s.cc + {e} * {e}",
                f"s.cu + {e} * s.lu", "s.uu + s.lu * s.lu", f"s.c + {e}", "s.u + s.lu")
    return (f"list_reduce(list_concat([{start}], list_transform(ys, lambda y: {pack('y', *[zero] * 7)})), lambda s, x: {step})")


SES_SSE = "greatest(f.cc - (f.cu / f.uu) * f.cu, 0.0)"


def ses_ctes(src: str, name: str, k: int = 20) -> list[str]:
    """The alpha grid with the best start level of each alpha, then a golden-section
    search between the neighbours of its best point, one row per segment and step."""
    left = "fc <= fd"
    return [
        f"""{name}_y AS (SELECT segment, list(value ORDER BY t) AS ys, arg_min(value, t) AS y1, max(n) AS n
  FROM {src} WHERE n >= 2 GROUP BY segment)""",
        f"""{name}_top AS (SELECT segment, ys, y1, n, alpha AS g_alpha, sse AS g_sse FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY sse, alpha) AS rk FROM (SELECT *, {SES_SSE} AS sse FROM (
    SELECT s.*, g.alpha, {_ses_fold("g.alpha")} AS f FROM {name}_y s CROSS JOIN (SELECT DISTINCT alpha FROM grid) g))) WHERE rk = 1)""",
        f"""{name}_0 AS (SELECT *, hi - {GOLDEN} * (hi - lo) AS c, lo + {GOLDEN} * (hi - lo) AS d FROM (
  SELECT segment, ys, y1, greatest(g_alpha - {1.0 / k!r}, 0.0) AS lo, least(g_alpha + {1.0 / k!r}, 1.0) AS hi FROM {name}_top))""",
        f"""{name}_gs(segment, ys, y1, i, lo, hi, c, d, fc, fd) AS (
  SELECT segment, ys, y1, 0, lo, hi, c, d, fc, {SES_SSE} FROM (SELECT * EXCLUDE (f), {_ses_fold("d")} AS f FROM (
    SELECT *, {SES_SSE} AS fc FROM (SELECT *, {_ses_fold("c")} AS f FROM {name}_0)))
  UNION ALL
  SELECT segment, ys, y1, i + 1, nlo, nhi, nc, nd, CASE WHEN {left} THEN {SES_SSE} ELSE fd END, CASE WHEN {left} THEN fc ELSE {SES_SSE} END
  FROM (SELECT *, {_ses_fold(f"CASE WHEN {left} THEN nc ELSE nd END")} AS f FROM (
    SELECT *, CASE WHEN {left} THEN lo ELSE c END AS nlo, CASE WHEN {left} THEN d ELSE hi END AS nhi,
      CASE WHEN {left} THEN d - {GOLDEN} * (d - lo) ELSE d END AS nc, CASE WHEN {left} THEN c ELSE c + {GOLDEN} * (hi - c) END AS nd
    FROM {name}_gs WHERE i < {GOLDEN_STEPS})))""",
        f"""{name}_mid AS (SELECT segment, ys, y1, n, CASE WHEN {SES_SSE} < g_sse THEN mid ELSE g_alpha END AS alpha FROM (
  SELECT t.*, m.mid, {_ses_fold("m.mid").replace("ys,", "t.ys,").replace("- y1", "- t.y1")} AS f
  FROM {name}_top t JOIN (SELECT segment, (lo + hi) / 2 AS mid FROM {name}_gs WHERE i = {GOLDEN_STEPS}) m USING (segment)))""",
        f"""{name}_best AS (SELECT segment, alpha, y1 + f.lc + f.lu * (f.cu / f.uu) AS level, (f.c - f.u * (f.cu / f.uu)) / n AS bias,
   {SES_SSE} AS sse FROM (SELECT *, {_ses_fold("alpha")} AS f FROM {name}_mid))""",
    ]


def tail_stats_cte(src: str, name: str, tail: int = 30, sma: int = 7) -> str:
    """Per segment: last date/value, OLS on the last ``tail`` points, mean
    of the last ``sma`` points."""
    return f"""{name} AS (SELECT segment, max(date) AS last_date, arg_max(value, t) AS last_value,
   least(max(n), {tail}) AS m30,
   regr_slope(value, CASE WHEN t > n - {tail} THEN CAST(t - greatest(n - {tail}, 0) - 1 AS DOUBLE) END) AS slope30,
   regr_intercept(value, CASE WHEN t > n - {tail} THEN CAST(t - greatest(n - {tail}, 0) - 1 AS DOUBLE) END) AS icpt30,
   avg(CASE WHEN t > n - {sma} THEN value END) AS sma
  FROM {src} GROUP BY segment)"""
