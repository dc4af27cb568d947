"""Property tests: distributed running sums and average ranks equal the
single-machine definitions on random data with groups and heavy ties."""

import numpy as np
import pandas as pd
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from ledgerscope.operators import ranking as RK

rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 15)),
                min_size=1, max_size=120)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_average_rank_by_group(spark, data):
    pdf = pd.DataFrame(data, columns=["g", "v"]).assign(i=range(len(data)))
    pdf["v"] = pdf["v"].astype(float)
    df = spark.createDataFrame(pdf)
    got = RK.average_rank(df, "v", "r", by=("g",)).toPandas().sort_values("i")["r"].to_numpy()
    want = pdf.groupby("g")["v"].rank(method="average").to_numpy()
    assert np.allclose(got, want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=150, unique=True))
def test_running_sum_descending(spark, vals):
    pdf = pd.DataFrame({"k": vals, "x": [1.0] * len(vals)})
    df = spark.createDataFrame(pdf)
    got = RK.running_sums(df, "k", ["x"], ascending=False).toPandas()
    want = pdf["k"].rank(ascending=False, method="first")
    got = got.set_index("k").loc[pdf["k"], "run_x"].to_numpy()
    assert np.array_equal(got, want.to_numpy())
