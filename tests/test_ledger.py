"""ledger_to_panel against a plain pandas computation on a hand-made
ledger: a hot customer with a third of all flows, flows before the window,
same-day flows, a customer without flows and an orphan flow."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd

from ledgerscope.sources import ledger as L

END = dt.date(2024, 3, 31)
DAYS = 60


def test_panel_matches_pandas(spark):
    rng = np.random.default_rng(9)
    flows = []
    for i in range(300):
        cid = 1 if i % 3 == 0 else int(rng.integers(2, 6))       # customer 1 is hot
        day = END - dt.timedelta(days=int(rng.integers(0, 120)))  # half before the window
        flows.append((cid, day, Decimal(str(round(float(rng.normal(0, 500)), 2)))))
    flows.append((99, END, Decimal("10.00")))                    # orphan: no account
    accts = [(c, "A" if c % 2 else "B", Decimal(str(100 * c))) for c in range(1, 7)]  # 6 has no flows
    f = spark.createDataFrame(flows, "customer_id bigint, date date, amount decimal(18,5)")
    a = spark.createDataFrame(accts, "customer_id bigint, segment string, opening decimal(18,5)")
    got = L.ledger_to_panel(f, a, days=DAYS).toPandas()

    start = END - dt.timedelta(days=DAYS - 1)
    fl = pd.DataFrame(flows, columns=["customer_id", "date", "amount"])
    rows = []
    for cid, seg, opening in accts:
        mine = fl[fl.customer_id == cid]
        for k in range(DAYS):
            d = start + dt.timedelta(days=k)
            bal = opening + sum(mine[mine.date <= d].amount, Decimal(0))
            rows.append((cid, seg, d, float(round(bal, 2))))
    want = pd.DataFrame(rows, columns=["customer_id", "segment", "date", "balance"])
    key = ["customer_id", "date"]
    got = got.sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    assert len(got) == 6 * DAYS
    assert (got.customer_id.values == want.customer_id.values).all()
    assert (got.segment.values == want.segment.values).all()
    assert (got.date.values == want.date.values).all()
    assert np.array_equal(got.balance.values, want.balance.values)
