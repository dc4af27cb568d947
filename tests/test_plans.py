"""Plan shape: per-customer work on the panel adds no exchange.

The panel build has two hash exchanges, (customer_id, date) for the
pre-aggregated flows and (customer_id) for the expansion; after that,
every per-customer window, aggregate and join must reuse that
partitioning. Only the final per-segment roll-ups may shuffle again.
"""

import re

import pytest

from ledgerscope.operators import features as FT
from ledgerscope.operators import scores as S
from ledgerscope.operators import segments as G
from ledgerscope.operators import windows as W
from ledgerscope.sources import ledger as L

SMOKE = "/root/testdata/sf0.001"


def exchange_keys(df):
    plan = df._jdf.queryExecution().executedPlan().treeString()
    keys = set()
    for m in re.finditer(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        cols = [re.sub(r"#\d+L?", "", c.strip()) for c in m.group(1).split(",")]
        keys.add(tuple(c for c in cols if not c.isdigit()))
    return keys


PANEL_KEYS = {("customer_id",), ("customer_id", "date")}


@pytest.mark.parametrize("build,extra", [
    (lambda p: S.customer_scores(p), set()),
    (lambda p: W.rolling_scores(p), set()),
    (lambda p: W.hopping_scores(p), set()),
    (lambda p: FT.customer_features(p), set()),
    (lambda p: G.segment_heatmap(p), {("segment",)}),
    (lambda p: W.rolling_daily_fhs(p), {("segment", "end_date")}),
    (lambda p: G.shocked_heatmaps_fast(p, (0, 10, 25)), {("shock", "segment")}),
])
def test_no_exchange_after_panel(spark, build, extra):
    keys = exchange_keys(build(L.line_panel(spark, SMOKE)))
    assert keys <= PANEL_KEYS | extra, keys


def test_bucketed_panel_table_needs_no_shuffle(spark):
    """A panel saved with bucketBy(customer_id) feeds per-customer scores
    with no exchange at all before the segment roll-up."""
    from ledgerscope.sources.panel_store import save_panel_table
    t = save_panel_table(L.line_panel(spark, SMOKE), name="test_panel_bucketed", buckets=4)
    keys = exchange_keys(S.customer_scores(t))
    assert keys == set(), keys
    keys = exchange_keys(G.segment_heatmap(t))
    assert keys <= {("segment",)}, keys
    assert t.count() == L.line_panel(spark, SMOKE).count()
