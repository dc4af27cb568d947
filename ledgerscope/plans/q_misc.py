"""Queries: panel windows, score primitives, shocks, labels, lookups, text,
sampling, statistics and classification metrics (SURVEY 2.1-2.12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerscope.functions import expr as X
from ledgerscope.operators import lookups as LK
from ledgerscope.operators import metrics as MT
from ledgerscope.operators import ranking as RK
from ledgerscope.operators import runs as R
from ledgerscope.operators import scores as S
from ledgerscope.operators import segments as G
from ledgerscope.operators import stats as ST
from ledgerscope.operators import windows as W
from ledgerscope.plans import sqlkit as Q
from ledgerscope.plans.q_features import FEAT, feature_table as features
from ledgerscope.plans.q_forecast import ALL_K, alerts
from ledgerscope.plans.registry import register
from ledgerscope.session import materialize
from ledgerscope.sources import ledger as L

LINES = Q.panel_ctes("lines")
SCORES = Q.score_ctes()
P_SC = Q.with_(*LINES, *SCORES)
HEAT = Q.with_(*LINES, *SCORES, Q.heatmap_cte())
SEG = "BUILDING"
SHOCK = 20
GRID = (0, 10, 25, 35)


def panel(spark, sf, keep_last=None):
    return L.line_panel(spark, sf, keep_last=keep_last)


def cut_date(spark, sf):
    return G.shock_cut(L.calendar_bounds(L.line_dates(spark, sf)))


def scores(spark, sf):
    return R.customer_scores(L.line_runs(spark, sf))


def heat(spark, sf):
    return R.segment_heatmap(L.line_runs(spark, sf))


# ---- 2.1 sources ---------------------------------------------------------------

@register("segment_dim", sql=Q.with_(*LINES) + "SELECT DISTINCT segment FROM panel")
def segment_dim(spark, sf):
    # every account has a panel, so the account table already lists the segments
    return L.accounts(spark, sf).select("segment").distinct().orderBy("segment")


# ---- 2.2 projections, filters, labels ---------------------------------------------

@register("filter_segment", sql=Q.with_(*LINES) + f"SELECT * FROM panel WHERE segment = '{SEG}'")
def filter_segment(spark, sf):
    return panel(spark, sf).where(F.col("segment") == SEG)


SHOCKED = Q.with_(*LINES) + f"""
SELECT customer_id, segment, date,
  CASE WHEN date >= (SELECT max(date) FROM panel) - 30 THEN balance - balance * ({SHOCK} / 100.0)
       ELSE balance END AS balance
FROM panel"""


@register("stress_shock", sql=SHOCKED)
def stress_shock(spark, sf):
    return G.stress_shock(panel(spark, sf), SHOCK, cut=cut_date(spark, sf))


def _grid_sql():
    shocks = ", ".join(f"({s})" for s in GRID)
    return [
        f"shocks AS (SELECT CAST(s AS INTEGER) AS shock FROM (VALUES {shocks}) t(s))",
        f"""gpanel AS (SELECT p.customer_id, s.shock, p.segment, p.date,
   CASE WHEN s.shock > 0 AND p.date >= (SELECT max(date) FROM panel) - 30
        THEN p.balance - p.balance * (CAST(s.shock AS DOUBLE) / 100.0) ELSE p.balance END AS balance
  FROM panel p CROSS JOIN shocks s)""",
        *Q.score_ctes("gpanel", keys="customer_id, shock, segment", series="customer_id, shock", name="gs"),
        Q.heatmap_cte("gs", keys="shock, segment", name="gheat"),
    ]


GRID_SQL = Q.with_(*LINES, *_grid_sql())


def grid_heat(spark, sf, shocks=GRID):
    return R.shocked_heatmaps(L.line_runs(spark, sf), shocks, cut_date(spark, sf))


@register("stress_shock_grid", sql=GRID_SQL + "SELECT * FROM gheat")
def stress_shock_grid(spark, sf):
    return grid_heat(spark, sf)


@register("shock_band", sql=GRID_SQL + """
SELECT shock, segment, fhs, CASE WHEN shock <= 0 THEN 'none' WHEN shock <= 15 THEN 'mild'
  WHEN shock <= 30 THEN 'substantial' ELSE 'severe' END AS band FROM gheat""")
def shock_band(spark, sf):
    return grid_heat(spark, sf).select("shock", "segment", "fhs", X.shock_band("shock").alias("band"))


@register("scenario_comparison", sql=GRID_SQL + """
SELECT s.segment, b.fhs AS baseline_fhs, s.fhs AS shocked_fhs, s.risk_label,
  floor((s.fhs - b.fhs) * 100.0 + 0.5) / 100.0 AS delta,
  CASE WHEN s.fhs - b.fhs < -2 THEN 'negative' WHEN s.fhs - b.fhs > 2 THEN 'positive' ELSE 'neutral' END AS direction
FROM (SELECT * FROM gheat WHERE shock = 25) s JOIN (SELECT * FROM gheat WHERE shock = 0) b ON s.segment = b.segment""")
def scenario_comparison(spark, sf):
    g = grid_heat(spark, sf, (0, 25))
    return G.scenario_comparison(g.where(F.col("shock") == 25), g.where(F.col("shock") == 0))


@register("risk_label", sql=P_SC + f"SELECT customer_id, segment, fhs, {Q.risk_label('fhs')} AS risk_label FROM scores")
def risk_label(spark, sf):
    return scores(spark, sf).select("customer_id", "segment", "fhs", X.risk_label("fhs").alias("risk_label"))


@register("risk_word", sql=HEAT + """
SELECT segment, risk_label, CASE risk_label WHEN 'RED' THEN 'CRITICAL' WHEN 'AMBER' THEN 'AT-RISK'
  WHEN 'GREEN' THEN 'HEALTHY' END AS risk_word,
  CASE risk_label WHEN 'RED' THEN 'Critical' WHEN 'AMBER' THEN 'At-Risk' WHEN 'GREEN' THEN 'Healthy' END AS risk_word_title
FROM heatmap""")
def risk_word(spark, sf):
    return heat(spark, sf).select("segment", "risk_label", X.risk_word("risk_label").alias("risk_word"),
                                  X.risk_word_title("risk_label").alias("risk_word_title"))


def _badge_sql(c):
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 35.0 THEN 'score-red' "
            f"WHEN {c} < 60.0 THEN 'score-amber' ELSE 'score-green' END AS {c}_badge")


@register("score_badge", sql=HEAT + "SELECT segment, " + ", ".join(_badge_sql(c) for c in Q.PARTS) + " FROM heatmap")
def score_badge(spark, sf):
    h = heat(spark, sf)
    return h.select("segment", *[X.score_badge(c).alias(f"{c}_badge") for c in G.PARTS])


@register("round_columns", sql=P_SC + f"""
SELECT customer_id, {Q.hu('fhs_raw', 1)} AS fhs_1dp, {Q.hu('fhs_raw', 2)} AS fhs_2dp,
       {Q.hu('fhs_raw', 4)} AS fhs_4dp FROM scores""")
def round_columns(spark, sf):
    s = scores(spark, sf)
    return s.select("customer_id", X.half_up("fhs_raw", 1).alias("fhs_1dp"),
                    X.half_up("fhs_raw", 2).alias("fhs_2dp"), X.half_up("fhs_raw", 4).alias("fhs_4dp"))


@register("sort_heatmap", sql=HEAT + """
SELECT segment, fhs, row_number() OVER (ORDER BY fhs, segment) AS heat_rank FROM heatmap""")
def sort_heatmap(spark, sf):
    # one row per segment: an ordered window over the heatmap is bounded
    return heat(spark, sf).select("segment", "fhs", F.row_number().over(
        Window.orderBy("fhs", "segment")).cast("bigint").alias("heat_rank"))


@register("portfolio_kpis", sql=HEAT + """
SELECT CAST(count_if(risk_label = 'RED') AS BIGINT) AS critical,
       CAST(count_if(risk_label = 'AMBER') AS BIGINT) AS warning,
       CAST(count_if(risk_label = 'GREEN') AS BIGINT) AS healthy,
       (SELECT count(DISTINCT customer_id) FROM panel) AS total_customers,
       CAST(count_if(risk_label = 'RED') AS BIGINT) AS action_required FROM heatmap""")
def portfolio_kpis(spark, sf):
    return G.portfolio_kpis(scores(spark, sf))


# ---- 2.3 score primitives -------------------------------------------------------

for _name, _col in [("score_balance_trend", "balance_trend"), ("score_income_regularity", "income_regularity"),
                    ("score_spending_volatility", "spending_volatility"), ("score_debt_ratio", "debt_ratio")]:
    def _mk(col):
        def q(spark, sf):
            return scores(spark, sf).select("customer_id", col)
        return q
    register(_name, sql=P_SC + f"SELECT customer_id, {_col} FROM scores")(_mk(_col))


@register("fhs_composite", sql=P_SC + "SELECT customer_id, fhs FROM scores")
def fhs_composite(spark, sf):
    return scores(spark, sf).select("customer_id", "fhs")


MONTHLY = """mc AS (SELECT customer_id, CAST(date_trunc('month', date) AS DATE) AS month,
   arg_max(balance, date) AS close FROM panel GROUP BY customer_id, CAST(date_trunc('month', date) AS DATE))"""


@register("monthly_close", sql=Q.with_(*LINES, MONTHLY) + "SELECT * FROM mc")
def monthly_close(spark, sf):
    return S.monthly_close(panel(spark, sf))


@register("monthly_delta", sql=Q.with_(*LINES, MONTHLY) + """
SELECT customer_id, month, close, delta FROM (SELECT customer_id, month, close,
  CASE WHEN date_diff('month', lag(month) OVER w, month) = 1 THEN close - lag(close) OVER w END AS delta
  FROM mc WINDOW w AS (PARTITION BY customer_id ORDER BY month)) WHERE delta IS NOT NULL""")
def monthly_delta(spark, sf):
    return S.monthly_delta(S.monthly_close(panel(spark, sf)))


@register("calendar_month_bucket", sql=Q.with_(*LINES) + """
SELECT customer_id, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n_days,
       last_day(max(date)) AS month_end, arg_max(balance, date) AS close
FROM panel GROUP BY customer_id, CAST(date_trunc('month', date) AS DATE)""")
def calendar_month_bucket(spark, sf):
    return W.calendar_month_bucket(panel(spark, sf))


# ---- 2.5 window functions ---------------------------------------------------------

@register("win_daily_diff", sql=Q.with_(*LINES) + f"""
SELECT customer_id, date, {Q.hu('balance - lag(balance) OVER (PARTITION BY customer_id ORDER BY date)', 2)} AS diff
FROM panel""")
def win_daily_diff(spark, sf):
    d = R.by_kind(L.line_runs(spark, sf), R.daily_diff, W.daily_diff)
    return d.select("customer_id", "date", X.half_up("diff", 2).alias("diff"))


@register("win_running_max", sql=Q.with_(*LINES) + """
SELECT customer_id, date, max(balance) OVER (PARTITION BY customer_id ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max FROM panel""")
def win_running_max(spark, sf):
    return R.by_kind(L.line_runs(spark, sf), R.running_max, W.running_max).select("customer_id", "date", "running_max")


@register("win_row_index", sql=Q.with_(*LINES) + """
SELECT customer_id, date, row_number() OVER (PARTITION BY customer_id ORDER BY date) - 1 AS idx FROM panel""")
def win_row_index(spark, sf):
    return R.by_kind(L.line_runs(spark, sf), R.row_index, W.row_index).select("customer_id", "date", "idx")


@register("win_first_last", sql=Q.with_(*LINES) + """
SELECT customer_id, min(date) AS first_date, max(date) AS last_date,
       arg_min(balance, date) AS first_value, arg_max(balance, date) AS last_value
FROM panel GROUP BY customer_id""")
def win_first_last(spark, sf):
    return W.first_last(panel(spark, sf))


@register("win_tail_n", sql=Q.with_(*LINES) + """
SELECT customer_id, segment, date, balance FROM (SELECT *, row_number() OVER
  (PARTITION BY customer_id ORDER BY date DESC) AS rn FROM panel) WHERE rn <= 30""")
def win_tail_n(spark, sf):
    return R.by_kind(L.line_runs(spark, sf), lambda runs: R.tail_n(runs, 30), lambda days: W.tail_n(days, 30))


@register("rank_average", sql=FEAT + """
SELECT customer_id, runway_mean, rank() OVER (ORDER BY runway_mean)
  + (count(*) OVER (PARTITION BY runway_mean) - 1) / 2.0 AS runway_rank FROM features""")
def rank_average(spark, sf):
    f = features(spark, sf).select("customer_id", "runway_mean")
    return RK.average_rank(f, "runway_mean", "runway_rank")


# ---- 2.6 / 2.8 joins --------------------------------------------------------------

SPINE = """spine AS (SELECT DISTINCT date AS end_date FROM panel WHERE date > (SELECT max(date) FROM panel) - 45)"""


@register("window_range_join", sql=Q.with_(*LINES, SPINE) + f"""
SELECT p.segment, s.end_date, count(*) AS n_rows, {Q.exact_avg('p.balance')} AS mean_balance
FROM spine s JOIN panel p ON p.date BETWEEN s.end_date - 180 AND s.end_date
GROUP BY p.segment, s.end_date""")
def window_range_join(spark, sf):
    """A spine of the last 45 days range-joined to the days before each. The
    panel is first summed per (segment, day) -- money as exact decimals --
    so the join reads about 225 rows per segment, not the panel."""
    p = panel(spark, sf, keep_last=W.rolling_rows())
    days = p.groupBy("segment", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("balance").cast("decimal(18,2)")).alias("total"))
    ends = L.calendar_bounds(L.line_dates(spark, sf)).select(
        F.explode(F.sequence(F.date_sub("d_end", 44), "d_end")).alias("end_date"))
    j = days.join(ends, (days["date"] >= F.date_sub("end_date", 180)) & (days["date"] <= F.col("end_date")))
    return j.groupBy("segment", "end_date").agg(
        F.sum("n").alias("n_rows"), (F.sum("total").cast("double") / F.sum("n")).alias("mean_balance"))


@register("panel_calendar_join", sql=Q.with_(*LINES) + "SELECT * FROM panel")
def panel_calendar_join(spark, sf):
    """The calendar plan of the panel: each account row generates its own
    calendar of months (explode of a date sequence, no cross join), daily net
    flows are left-joined onto it and summed per customer in date order; then
    every month generates its days. Only months and flows are shuffled and
    sorted, no days. Account rows with one key go by ``calendar_of_days``."""
    flows = L.line_ledger(spark, sf)
    acc = L.accounts(spark, sf)
    b = F.broadcast(L.calendar_bounds(L.line_dates(spark, sf)))
    daily = (flows.crossJoin(b).select("customer_id", F.greatest("date", "d_start").alias("date"), "amount")
             .groupBy("customer_id", "date").agg(F.sum("amount").alias("net")))
    acc = acc.withColumn("_twice", F.count(F.lit(1)).over(Window.partitionBy("customer_id")) > 1)
    once, twice = (acc.where(c).drop("_twice") for c in (~F.col("_twice"), F.col("_twice")))
    return calendar_of_months(once, daily, b).unionByName(calendar_of_days(twice, daily, b))


def calendar_of_months(acc, daily, b):
    month = F.trunc("date", "month")
    moved = daily.groupBy("customer_id", month.alias("month")).agg(
        F.sum("net").alias("total"), F.collect_list(F.struct("date", F.col("net").cast("decimal(28,5)").alias("net"))).alias("nets"))
    months = F.sequence(F.trunc("d_start", "month"), F.trunc("d_end", "month"), F.expr("interval 1 month"))
    grid = acc.crossJoin(b).select("customer_id", "segment", "opening", "d_start", "d_end", F.explode(months).alias("month"))
    j = grid.join(moved, ["customer_id", "month"], "left")
    w = Window.partitionBy("customer_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(28,5)")
    before = F.coalesce(F.sum("total").over(w), F.lit(0))
    days = F.explode(F.sequence(F.greatest("month", "d_start"), F.least(F.last_day("month"), "d_end"))).alias("date")
    # the sums first, then the days: in one select the days would be written out below the window
    j = j.select("customer_id", "segment", "month", "d_start", "d_end", (F.col("opening") + before).cast("decimal(28,5)").alias("held"), "nets")
    j = j.select("customer_id", "segment", "held", "nets", days)
    moved = F.aggregate(F.coalesce("nets", F.array().cast("array<struct<date:date,net:decimal(28,5)>>")), zero,
                        lambda s, x: (s + F.when(x["date"] <= F.col("date"), F.coalesce(x["net"], zero)).otherwise(zero)).cast("decimal(28,5)"))
    return j.select("customer_id", "segment", "date", F.round(F.col("held") + moved, 2).cast("double").alias("balance"))


def calendar_of_days(acc, daily, b):
    """The plan day by day, which shuffles the dense grid: rows of a repeated key add up one after the other."""
    grid = acc.crossJoin(b).select("customer_id", "segment", "opening",
                                   F.explode(F.sequence("d_start", "d_end")).alias("date"))
    j = grid.join(daily, ["customer_id", "date"], "left")
    w = Window.partitionBy("customer_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    bal = F.col("opening") + F.sum(F.coalesce("net", F.lit(0).cast("decimal(18,5)"))).over(w)
    return j.select("customer_id", "segment", "date", F.round(bal, 2).cast("double").alias("balance"))


ACT_VALUES = ", ".join(f"('{s}', '{t}', '{a}')" for s, t, a in LK.ACTIONS)
EXP_VALUES = ", ".join(f"('{s}', '{e}')" for s, e in LK.EXPLANATIONS)
DIMS = [f"adim AS (SELECT * FROM (VALUES {ACT_VALUES}) t(segment, tier, action))",
        f"edim AS (SELECT * FROM (VALUES {EXP_VALUES}) t(segment, explanation))"]


@register("action_lookup", sql=Q.with_(*LINES, *SCORES, Q.heatmap_cte(), *DIMS) + f"""
SELECT h.segment, h.risk_label, coalesce(a.action, '{LK.DEFAULT_ACTION}') AS recommended_action
FROM heatmap h LEFT JOIN adim a ON a.segment = h.segment AND a.tier = h.risk_label""")
def action_lookup(spark, sf):
    return LK.action_lookup(heat(spark, sf).select("segment", "risk_label"), "risk_label")


AL = ALL_K.rstrip() + ",\n" + ",\n".join(DIMS) + "\n"


@register("alert_action", sql=AL + f"""
SELECT x.segment, x.severity, x.action_tier, coalesce(a.action, '{LK.DEFAULT_ACTION}') AS recommended_action
FROM (SELECT *, CASE WHEN severity = 'CRITICAL' THEN 'RED' ELSE 'AMBER' END AS action_tier FROM alerts) x
LEFT JOIN adim a ON a.segment = x.segment AND a.tier = x.action_tier""")
def alert_action(spark, sf):
    a = LK.alert_tier(alerts(spark, sf)).select("segment", "severity", "action_tier")
    return LK.action_lookup(a, "action_tier")


EXPL_SQL = f"coalesce(e.explanation, printf('{LK.DEFAULT_EXPLANATION}', x.segment))"


@register("fallback_explanation", sql=AL + f"""
SELECT x.segment, {EXPL_SQL} AS explanation FROM alerts x LEFT JOIN edim e ON e.segment = x.segment""")
def fallback_explanation(spark, sf):
    return LK.fallback_explanation(alerts(spark, sf).select("segment"))


@register("alert_explanation_join", sql=AL + f"""
SELECT x.segment, x.severity, x.fhs_day1, x.fhs_day30, x.min_lower, x.declining,
       coalesce({EXPL_SQL}, '') AS explanation,
       coalesce(a.action, '{LK.DEFAULT_ACTION}') AS recommended_action
FROM alerts x LEFT JOIN edim e ON e.segment = x.segment
LEFT JOIN adim a ON a.segment = x.segment AND a.tier = CASE WHEN x.severity = 'CRITICAL' THEN 'RED' ELSE 'AMBER' END""")
def alert_explanation_join(spark, sf):
    a = alerts(spark, sf)
    ex = LK.fallback_explanation(a.select("segment"))
    j = a.join(ex, "segment", "left").withColumn("explanation", F.coalesce("explanation", F.lit("")))
    j = LK.action_lookup(LK.alert_tier(j), "action_tier").drop("action_tier")
    return j.select("segment", "severity", "fhs_day1", "fhs_day30", "min_lower", "declining",
                    "explanation", "recommended_action")


# ---- 2.10 text --------------------------------------------------------------------

@register("alert_prompt_text", sql=ALL_K + """
SELECT segment, printf('Segment: %s | Health score day 1: %.1f / 100 | day 30: %.1f / 100 | worst-case lower bound: %.1f / 100 | severity: %s | declining: %s',
  segment, fhs_day1, fhs_day30, min_lower, severity, CAST(declining AS VARCHAR)) AS prompt FROM alerts""")
def alert_prompt_text(spark, sf):
    return LK.prompt_text(alerts(spark, sf))


@register("explanation_sentences", sql=AL + f"""
SELECT segment, CAST(pos AS BIGINT) AS pos, trim(sentence) AS sentence FROM (
  SELECT segment, unnest(parts) AS sentence, unnest(range(1, len(parts) + 1)) AS pos FROM (
    SELECT x.segment, list_filter(string_split(regexp_replace({EXPL_SQL}, '\\.\\s', '.' || chr(1), 'g'), chr(1)),
                                  lambda s: length(trim(s)) > 3) AS parts
    FROM alerts x LEFT JOIN edim e ON e.segment = x.segment))""")
def explanation_sentences(spark, sf):
    return LK.sentences(LK.fallback_explanation(alerts(spark, sf).select("segment")))


@register("first_nonblank_by_priority", sql=AL + f"""
SELECT x.segment, coalesce(CASE WHEN length(trim(c1)) > 0 THEN c1 END,
                           CASE WHEN length(trim(c2)) > 0 THEN c2 END, c3) AS explanation
FROM (SELECT x.segment, '' AS c1, e.explanation AS c2,
             printf('{LK.DEFAULT_EXPLANATION}', x.segment) AS c3
      FROM alerts x LEFT JOIN edim e ON e.segment = x.segment) x""")
def first_nonblank_by_priority(spark, sf):
    """Candidates in priority order: a generated reply (none offline, so
    blank), the curated text, the templated default."""
    a = alerts(spark, sf).select("segment")
    dim = F.broadcast(LK.explanation_dim(spark)).withColumnRenamed("segment", "_s")
    c = a.join(dim, a["segment"] == dim["_s"], "left").select(
        "segment", F.lit("").alias("c1"), F.col("explanation").alias("c2"),
        F.format_string(LK.DEFAULT_EXPLANATION, "segment").alias("c3"))
    return c.select("segment", LK.first_nonblank("c1", "c2", "c3").alias("explanation"))


# ---- 2.7 sampling -------------------------------------------------------------------

SAMPLE = """samp AS (SELECT customer_id, segment FROM (SELECT DISTINCT customer_id, segment FROM panel)
  QUALIFY row_number() OVER (PARTITION BY segment ORDER BY md5(concat_ws(':', segment, CAST(customer_id AS VARCHAR))),
                             customer_id) <= 30)"""


def sample(spark, sf):
    acc = L.accounts(spark, sf).select("customer_id", "segment")
    w = Window.partitionBy("segment").orderBy(
        F.md5(F.concat_ws(":", "segment", F.col("customer_id").cast("string"))), "customer_id")
    # row_number() <= n per group is planned with a map-side group limit,
    # so no segment ever ships more than n rows per task to the reducer
    return acc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 30).drop("_rn")


@register("stratified_top_n_sample", sql=Q.with_(*LINES, SAMPLE) + "SELECT * FROM samp")
def stratified_top_n_sample(spark, sf):
    return sample(spark, sf)


@register("sample_semi_join", sql=Q.with_(*LINES, SAMPLE) + """
SELECT p.* FROM panel p SEMI JOIN samp s ON s.customer_id = p.customer_id""")
def sample_semi_join(spark, sf):
    return panel(spark, sf).join(sample(spark, sf).select("customer_id"), "customer_id", "left_semi")


SPLIT = """split AS (SELECT customer_id, segment, risk_tier,
  CASE WHEN row_number() OVER (PARTITION BY risk_tier ORDER BY md5(CAST(customer_id AS VARCHAR)))
            <= floor(0.8 * count(*) OVER (PARTITION BY risk_tier) + 0.5) THEN 'train' ELSE 'test' END AS split
  FROM features)"""


def split(spark, sf):
    f = features(spark, sf)
    return stratified_split(f)


def stratified_split(f):
    """Exact per-class 80/20 split in a hash order; positions come from the
    distributed running count (no per-class single-task window)."""
    k = f.withColumn("_h", F.md5(F.col("customer_id").cast("string"))).withColumn("_one", F.lit(1.0))
    r = RK.running_sums(k, "_h", ["_one"], by=("risk_tier",))
    n = f.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n.withColumnRenamed("risk_tier", "_tier"), F.col("risk_tier").eqNullSafe(F.col("_tier"))).drop("_tier")
    return r.withColumn("split", F.when(F.col("run__one") <= F.floor(F.col("_n") * 0.8 + 0.5), "train")
                        .otherwise("test")).drop("_h", "_one", "run__one", "_n")


@register("stratified_split", sql=FEAT.rstrip() + ",\n" + SPLIT + "\nSELECT customer_id, risk_tier, split FROM split")
def stratified_split_q(spark, sf):
    return split(spark, sf).select("customer_id", "risk_tier", "split")


@register("systematic_sample", sql=FEAT + """
SELECT customer_id, segment, _fhs_mean FROM (SELECT *, row_number() OVER (ORDER BY customer_id) AS rn,
  count(*) OVER () AS n FROM features) WHERE (rn - 1) % greatest(1, n // 200) = 0""")
def systematic_sample(spark, sf):
    f = features(spark, sf).select("customer_id", "segment", "_fhs_mean")
    r = RK.global_row_number(f, "customer_id")
    n = f.agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / 200))
    return (r.crossJoin(F.broadcast(n)).where(F.pmod(F.col("rn") - 1, step) == 0)
            .select("customer_id", "segment", "_fhs_mean"))


# ---- 2.12 statistics ----------------------------------------------------------------------

ANOVA = f"""g AS (SELECT segment, count(*) AS n_g, {Q.exact_avg('_fhs_mean')} AS m_g FROM features GROUP BY segment),
gr AS (SELECT {Q.exact_avg('_fhs_mean')} AS gm, count(*) AS n FROM features),
ss AS (SELECT sum((f._fhs_mean - g.m_g) * (f._fhs_mean - g.m_g)) AS ssw,
              sum((f._fhs_mean - gr.gm) * (f._fhs_mean - gr.gm)) AS sst
       FROM features f JOIN g ON g.segment = f.segment CROSS JOIN gr),
sb AS (SELECT sum(g.n_g * (g.m_g - gr.gm) * (g.m_g - gr.gm)) AS ssb, count(*) AS k FROM g CROSS JOIN gr),
anova AS (SELECT k, n, k - 1 AS df_between, n - k AS df_within,
  (ssb / (k - 1)) / (ssw / (n - k)) AS f, CASE WHEN sst > 0 THEN ssb / sst ELSE 0.0 END AS eta
  FROM ss, sb, gr)"""
A_SQL = FEAT.rstrip() + ",\n" + ANOVA + "\n"


def anova(spark, sf):
    return ST.anova_oneway(features(spark, sf), "_fhs_mean", "segment")


@register("anova_oneway", sql=A_SQL + f"""
SELECT k, n, df_between, df_within, {Q.hu('f', 4)} AS f_statistic FROM anova""")
def anova_oneway(spark, sf):
    return anova(spark, sf).select("k", "n", "df_between", "df_within", "f_statistic")


@register("eta_squared", sql=A_SQL + f"""
SELECT {Q.hu('eta', 4)} AS eta_squared, CASE WHEN eta > 0.14 THEN 'large' WHEN eta > 0.06 THEN 'medium'
  ELSE 'small' END AS effect_size FROM anova""")
def eta_squared(spark, sf):
    return anova(spark, sf).select("eta_squared", "effect_size")


RANKS = """rk AS (SELECT runway_mean, _fhs_mean,
  rank() OVER (ORDER BY runway_mean) + (count(*) OVER (PARTITION BY runway_mean) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY _fhs_mean) + (count(*) OVER (PARTITION BY _fhs_mean) - 1) / 2.0 AS ry FROM features)"""


@register("spearman", sql=FEAT.rstrip() + ",\n" + RANKS + f"""
SELECT {Q.hu('corr(rx, ry)', 4)} AS rho, count(*) AS n FROM rk""")
def spearman(spark, sf):
    return ST.spearman(features(spark, sf), "runway_mean", "_fhs_mean").select("rho", "n")


@register("correlation_label", sql=FEAT.rstrip() + ",\n" + RANKS + """
SELECT CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
       abs(r) > 0.3 AS captures_liquidity FROM (SELECT corr(rx, ry) AS r FROM rk)""")
def correlation_label(spark, sf):
    return ST.spearman(features(spark, sf), "runway_mean", "_fhs_mean").select(
        "strength", "direction", "captures_liquidity")


@register("effect_size_label", sql=A_SQL + """
SELECT CASE WHEN eta > 0.14 THEN 'large' WHEN eta > 0.06 THEN 'medium' ELSE 'small' END AS effect_size FROM anova""")
def effect_size_label(spark, sf):
    return anova(spark, sf).select("effect_size")


BETA = """parts AS (
  SELECT 'anova' AS test, floor(f * 10000.0 + 0.5) / 10000.0 AS statistic, df_within / 2.0 AS a0, df_between / 2.0 AS b0,
         df_within / (df_within + df_between * f) AS x0 FROM anova
  UNION ALL SELECT 'spearman', floor(r * 10000.0 + 0.5) / 10000.0, (n - 2) / 2.0, 0.5, 1.0 - r * r
  FROM (SELECT corr(rx, ry) AS r, count(*) AS n FROM rk)),
side AS (SELECT *, x0 < (a0 + 1) / (a0 + b0 + 2) AS direct FROM parts),
args AS (SELECT *, CASE WHEN direct THEN a0 ELSE b0 END AS a, CASE WHEN direct THEN b0 ELSE a0 END AS b,
         CASE WHEN direct THEN x0 ELSE 1 - x0 END AS x FROM side),
lentz(test, a, b, x, m, c, d, h) AS (
  SELECT test, a, b, x, 0, CAST(1 AS DOUBLE), 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1)) FROM args
  UNION ALL
  SELECT test, a, b, x, m + 1, 1 + v / c1, 1 / (1 + v * d1), h1 * (1 + v / c1) / (1 + v * d1)
  FROM (SELECT *, 1 + u / c AS c1, 1 / (1 + u * d) AS d1, h * (1 + u / c) / (1 + u * d) AS h1 FROM (
    SELECT *, (m + 1) * (b - (m + 1)) * x / ((a - 1 + 2 * (m + 1)) * (a + 2 * (m + 1))) AS u,
      -(a + (m + 1)) * (a + b + (m + 1)) * x / ((a + 2 * (m + 1)) * (a + 1 + 2 * (m + 1))) AS v
    FROM lentz WHERE m < 200 + ceil(4 * sqrt(greatest(a, b)))))),
tail AS (
  SELECT p.test, p.statistic, CASE WHEN direct THEN part ELSE 1 - part END AS p FROM (
    SELECT g.*, exp(lgamma(g.a + g.b) - lgamma(g.a) - lgamma(g.b) + g.a * ln(g.x) + g.b * ln(1 - g.x)) * l.h / g.a AS part
    FROM args g JOIN (SELECT test, arg_max(h, m) AS h FROM lentz GROUP BY test) l ON l.test = g.test) p)
SELECT test, statistic, CASE WHEN p < 1e-300 THEN p
    WHEN p < 0.01 THEN CAST(printf('%.2e', p) AS DOUBLE) ELSE floor(p * 1000000.0 + 0.5) / 1000000.0 END AS p_value,
  p < 0.05 AS significant FROM tail"""


@register("significance_tests", sql=A_SQL.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + RANKS + ",\n" + BETA)
def significance_tests(spark, sf):
    """p-values: the ANOVA F tail and the Spearman t tail."""
    return significance(features(spark, sf))


def significance(f):
    a = ST.with_anova_pvalue(ST.anova_oneway(f, "_fhs_mean", "segment")).select(
        F.lit("anova").alias("test"), F.col("f_statistic").alias("statistic"), "p_value", "significant")
    s = ST.with_spearman_pvalue(ST.spearman(f, "runway_mean", "_fhs_mean")).select(
        F.lit("spearman").alias("test"), F.col("rho").alias("statistic"), "p_value", "significant")
    return a.unionByName(s)


# ---- classification metric tables on a rule-based prediction -------------------------
# actual = tier from the hopping-window mean; predicted = tier of the
# full-history score of the same panel; one-vs-rest scores from it.

PRED = Q.score_ctes("panel", name="osc")
CLS_SQL = FEAT.rstrip() + ",\n" + ",\n".join(PRED) + f""",
pred AS (SELECT f.customer_id, f.risk_tier AS actual, {Q.risk_tier('o.fhs')} AS predicted, o.fhs
  FROM features f JOIN osc o ON o.customer_id = f.customer_id),
scored AS (SELECT p.customer_id, c.class, CASE WHEN p.actual = c.class THEN 1 ELSE 0 END AS is_pos,
  CASE c.class WHEN 'High' THEN 100.0 - p.fhs WHEN 'Low' THEN p.fhs ELSE -abs(p.fhs - 67.5) END AS score
  FROM pred p CROSS JOIN (SELECT * FROM (VALUES ('High'), ('Low'), ('Medium')) t(class)) c)
"""


def predictions(spark, sf):
    f = features(spark, sf).select("customer_id", F.col("risk_tier").alias("actual"))
    o = R.by_kind(L.order_runs(spark, sf), R.customer_scores, S.customer_scores).select("customer_id", "fhs")
    return f.join(o, "customer_id").withColumn("predicted", X.risk_tier("fhs"))


def scored(spark, sf):
    p = materialize(predictions(spark, sf))     # ranks and curves read it several times
    cls = F.explode(F.array(F.lit("High"), F.lit("Low"), F.lit("Medium"))).alias("class")
    s = p.select("customer_id", "actual", "fhs", cls)
    score = (F.when(F.col("class") == "High", F.lit(100.0) - F.col("fhs"))
             .when(F.col("class") == "Low", F.col("fhs")).otherwise(-F.abs(F.col("fhs") - 67.5)))
    return s.select("customer_id", "class", (F.col("actual") == F.col("class")).cast("int").alias("is_pos"),
                    score.alias("score"))


@register("confusion_matrix", sql=CLS_SQL + "SELECT actual, predicted, count(*) AS n FROM pred GROUP BY actual, predicted")
def confusion_matrix(spark, sf):
    return MT.confusion(predictions(spark, sf))


def _report_sql():
    return CLS_SQL.rstrip() + f""",
cm AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY actual, predicted),
cls AS (SELECT actual AS c FROM cm UNION SELECT predicted FROM cm),
per AS (SELECT cls.c AS cls,
   coalesce((SELECT sum(n) FROM cm WHERE actual = cls.c), 0) AS support,
   coalesce((SELECT sum(n) FROM cm WHERE predicted = cls.c), 0) AS n_pred,
   coalesce((SELECT sum(n) FROM cm WHERE actual = cls.c AND predicted = cls.c), 0) AS tp FROM cls),
per2 AS (SELECT cls, support, tp,
   CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
per3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per2),
rep AS (SELECT cls, precision, recall, f1, support FROM per3
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM per3
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per3
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM per3)
SELECT cls AS class, {Q.hu('precision', 4)} AS precision, {Q.hu('recall', 4)} AS recall, {Q.hu('f1', 4)} AS f1,
       CAST(support AS BIGINT) AS support FROM rep"""


@register("classification_report", sql=_report_sql())
def classification_report(spark, sf):
    return MT.classification_report(materialize(predictions(spark, sf)))


@register("label_encode", sql=FEAT + """
SELECT customer_id, risk_tier, CAST(dense_rank() OVER (ORDER BY risk_tier) - 1 AS BIGINT) AS label_index FROM features""")
def label_encode(spark, sf):
    return MT.label_encode(features(spark, sf).select("customer_id", "risk_tier"), "risk_tier")


@register("roc_curve_ovr", sql=CLS_SQL + f"""
SELECT class, threshold, {Q.hu('fpr', 6)} AS fpr, {Q.hu('tpr', 6)} AS tpr FROM (
  SELECT class, score AS threshold,
    sum(neg) OVER (PARTITION BY class ORDER BY score DESC) / sum(neg) OVER (PARTITION BY class) AS fpr,
    sum(pos) OVER (PARTITION BY class ORDER BY score DESC) / sum(pos) OVER (PARTITION BY class) AS tpr
  FROM (SELECT class, score, CAST(sum(is_pos) AS DOUBLE) AS pos, CAST(sum(1 - is_pos) AS DOUBLE) AS neg
        FROM scored GROUP BY class, score)
  UNION ALL SELECT DISTINCT class, NULL, 0.0, 0.0 FROM scored)""")
def roc_curve_ovr(spark, sf):
    c = MT.roc_curve(scored(spark, sf))
    return c.select("class", "threshold", X.half_up("fpr", 6).alias("fpr"), X.half_up("tpr", 6).alias("tpr"))


@register("roc_auc_ovr", sql=CLS_SQL + f"""
SELECT class, {Q.hu('(sum(CASE WHEN is_pos = 1 THEN r END) - sum(is_pos) * (sum(is_pos) + 1) / 2.0) / (sum(is_pos) * sum(1 - is_pos))', 4)} AS auc
FROM (SELECT *, rank() OVER (PARTITION BY class ORDER BY score)
        + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM scored) GROUP BY class""")
def roc_auc_ovr(spark, sf):
    return MT.roc_auc(scored(spark, sf))


@register("curve_thinning", sql=CLS_SQL + f"""
, curve AS (
  SELECT class, score AS threshold,
    sum(neg) OVER (PARTITION BY class ORDER BY score DESC) / sum(neg) OVER (PARTITION BY class) AS fpr,
    sum(pos) OVER (PARTITION BY class ORDER BY score DESC) / sum(pos) OVER (PARTITION BY class) AS tpr
  FROM (SELECT class, score, CAST(sum(is_pos) AS DOUBLE) AS pos, CAST(sum(1 - is_pos) AS DOUBLE) AS neg
        FROM scored GROUP BY class, score)
  UNION ALL SELECT DISTINCT class, NULL, 0.0, 0.0 FROM scored)
SELECT class, threshold, {Q.hu('fpr', 6)} AS fpr, {Q.hu('tpr', 6)} AS tpr FROM (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY coalesce(fpr, 0.0) + coalesce(tpr, 0.0)) AS rn,
         count(*) OVER (PARTITION BY class) AS n FROM curve)
WHERE (rn - 1) % greatest(1, n // 50) = 0""")
def curve_thinning(spark, sf):
    c = MT.thin_curve(MT.roc_curve(scored(spark, sf)), points=50)
    return c.select("class", "threshold", X.half_up("fpr", 6).alias("fpr"), X.half_up("tpr", 6).alias("tpr"))
