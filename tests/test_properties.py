"""Property tests: ordered statistics equal their brute-force definitions on random data."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators.metrics import roc_auc
from tessera.operators.ranks import exact_quantiles

values = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(-5, 5).map(float)), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values)
def test_quantiles_with_ties(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    for g in {r[0] for r in rows}:
        xs = [x for k, x in rows if k == g]
        assert np.allclose(got[g], np.quantile(xs, probs))


labelled = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4).map(float)), min_size=2, max_size=50)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(labelled)
def test_auc_is_pairwise_win_rate(spark, rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    got = roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first().roc_auc
    if not pos or not neg:
        assert got is None
        return
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert np.isclose(got, wins / (len(pos) * len(neg)))
