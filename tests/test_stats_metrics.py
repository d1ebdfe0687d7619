"""Prefix sums, quantiles, p-values, classification metrics and rank windows vs hand-computed values."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators import metrics as MT
from tessera.operators.ranks import exact_quantiles, prefix_sums


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_prefix_sums_invariant_and_exact(spark, parts):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), float(rng.randint(0, 50)), 1.0) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, w double").groupBy("k", "v").agg(F.sum("w").alias("w"))
    out = prefix_sums(df.repartition(parts), ["k"], "v", ["w"]).toPandas()
    pdf = df.toPandas().sort_values(["k", "v"])
    pdf["expect"] = pdf.groupby("k")["w"].cumsum()
    m = out.merge(pdf, on=["k", "v"])
    assert len(m) == len(pdf) and np.allclose(m["cum_w"], m["expect"])


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1001).round(3)
    df = spark.createDataFrame([(float(v), "g" if i % 3 else "h") for i, v in enumerate(x)], "x double, g string")
    probs = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    pdf = df.toPandas()
    for g, sub in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(sub["x"], probs), atol=1e-12)


def test_ks_pvalue_series(spark):
    df = spark.createDataFrame([(1.0 / math.sqrt(50.0), 100.0, 100.0)], "d double, n double, m double")
    p = df.select(S.ks_pvalue(F.col("d"), F.col("n"), F.col("m"))).first()[0]
    # lambda = 1: Q = 2 Σ (−1)^(k−1) e^(−2k²)
    assert math.isclose(p, 0.26999967167735456, rel_tol=1e-9)


@pytest.mark.parametrize("x,dof,expect", [(2.0, 2, math.exp(-1)), (3.841458820694124, 1, 0.05),
                                          (7.814727903251178, 3, 0.05), (0.0, 4, 1.0), (float("inf"), 3, 0.0),
                                          (9.487729036781154, 4, 0.05)])
def test_chi2_survival(spark, x, dof, expect):
    df = spark.createDataFrame([(x, dof)], "x double, k int")
    p = df.select(S.chi2_sf(F.col("x"), F.col("k"))).first()[0]
    assert math.isclose(p, expect, abs_tol=2e-7)


def test_classification_metrics_weighted(spark):
    y = ["a", "a", "a", "b", "b", "c"]
    p = ["a", "b", "a", "b", "c", "c"]
    df = spark.createDataFrame(list(zip(y, p)), "y string, p string")
    m = MT.classification_metrics(df, "y", "p").first()
    # per class: a P=1 R=2/3, b P=1/2 R=1/2, c P=1/2 R=1; supports 3, 2, 1
    prec = (3 * 1 + 2 * 0.5 + 1 * 0.5) / 6
    rec = (3 * 2 / 3 + 2 * 0.5 + 1 * 1) / 6
    f1 = (3 * 0.8 + 2 * 0.5 + 1 * (2 / 3)) / 6
    assert math.isclose(m.accuracy, 4 / 6) and math.isclose(m.precision, prec)
    assert math.isclose(m.recall, rec) and math.isclose(m.f1_score, f1) and m.prediction_count == 6
    cm = {(r.actual, r.predicted): r.n for r in MT.confusion_matrix(df, "y", "p").collect()}
    assert len(cm) == 9 and cm[("a", "b")] == 1 and cm[("c", "a")] == 0


def test_roc_auc_ties_share_credit(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (0, 0.0)]
    auc = MT.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first().roc_auc
    # pairs (pos, neg): 9 total; wins: .9>{.1,.0}=2 + tie .9=0.5; .5>{.1,.0}=2; .1>.0=1 + tie .1=0.5
    assert math.isclose(auc, (2.5 + 2 + 1.5) / 9)


def test_log_loss_clips(spark):
    rows = [(1, 1.0), (0, 0.0), (1, 0.5)]
    ll = MT.log_loss(spark.createDataFrame(rows, "y int, p double"), "y", "p").first().log_loss
    eps = 1e-15
    assert math.isclose(ll, (-math.log(1 - eps) * 2 - math.log(0.5)) / 3)


def test_histogram_quantile_interpolates(spark):
    h = spark.createDataFrame([("m", 0.1, 10), ("m", 0.5, 60), ("m", 1.0, 100), ("m", float("inf"), 100)],
                              "k string, le double, count bigint")
    q = MT.histogram_quantile(h, ["k"], 0.5).first().quantile
    # rank 50 falls in (0.1, 0.5]: 0.1 + 0.4 * (50 - 10) / 50
    assert math.isclose(q, 0.1 + 0.4 * 40 / 50)


def test_rolling_and_recent_vs_older_match_pandas(spark):
    rng = random.Random(1)
    rows = [(i, "m" + str(i % 2), i * 10 + rng.randint(0, 5), rng.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, model string, ts bigint, c int")
    out = MT.rolling_accuracy(df, ["model"], ["ts", "id"], F.col("c") == 1, 25).toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "model", "ts", "c"]).sort_values(["model", "ts", "id"])
    pdf["expect"] = pdf.groupby("model")["c"].transform(lambda s: s.rolling(25, min_periods=1).mean())
    m = out.merge(pdf[["id", "expect"]], on="id")
    assert len(m) == 400 and np.allclose(m["rolling_accuracy"], m["expect"])
    rv = {r.model: r for r in MT.recent_vs_older(df, ["model"], ["ts", "id"], F.col("c") == 1, 50).collect()}
    for mname, sub in pdf.groupby("model"):
        assert math.isclose(rv[mname].older_accuracy, sub["c"].head(50).mean())
        assert math.isclose(rv[mname].recent_accuracy, sub["c"].tail(50).mean())


def test_chi2_tail_at_many_degrees_of_freedom(spark):
    from tessera.functions import stats as S

    # exact: finite sums in log space; about one half at the mean, whatever the parity
    for dof in (200, 201, 1600, 2001, 5001):
        xs = [dof * 0.95, float(dof), dof * 1.05, dof * 2.0, 1e6]
        got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(
            S.chi2_sf(F.col("x"), F.lit(dof))).collect()]
        want = [duckdb.sql(f"select {S.chi2_sf_sql(str(x), str(dof))}").fetchall()[0][0] for x in xs]
        assert got == pytest.approx(want, abs=2e-7)
        assert 0.48 < got[1] < 0.5 and got[4] == 0.0


def test_wide_categorical_is_not_drift_by_itself(spark):
    from tessera.operators import drift as D

    ref = spark.range(60_000).select((F.col("id") % 3000).cast("string").alias("c"))
    cur = spark.range(60_000).select(((F.col("id") * 7) % 3000).cast("string").alias("c"))
    row = D.data_drift(ref, cur, ["c"], with_psi=False).first()
    assert not row["drift_detected"] and row["p_value"] > 0.9


def test_null_keys_are_one_group(spark):
    from tessera.operators import metrics as MT
    from tessera.operators.ml import stratified_split
    from tessera.operators.ranks import prefix_sums

    rows = [(m, i, float(i % 2)) for m in (None, "a") for i in range(6)]
    df = spark.createDataFrame(rows, "m string, i long, v double")
    for n in (1, 4, 17):
        got = prefix_sums(df.repartition(n), ["m"], "i", ["v"], num_partitions=n).collect()
        assert {(r.m, r.i): (r.cum_v, r.total_v) for r in got} == {(m, i): (float((i + 1) // 2), 3.0) for m, i, _ in rows}
    rolling = MT.rolling_accuracy(df, ["m"], ["i"], F.col("v"), 2).collect()
    assert {(r.m, r.rank): r.rolling_accuracy for r in rolling} == {
        (m, i + 1): (0.0 if i == 0 else 0.5) for m in (None, "a") for i in range(6)}
    lat = MT.latency_summary(df.withColumn("t", F.col("i")), ["m"], "t", "i").collect()
    assert {r.m: r.p95_ms for r in lat} == {None: 4.75, "a": 4.75}
    split = stratified_split(df.withColumn("label", F.when(F.col("m") == "a", 1.0)), "label", ["i"], 0.5, 0.25)
    assert {tuple(r) for r in split.groupBy("label", "split").count().collect()} == {
        (y, s, n) for y in (None, 1.0) for s, n in (("train", 3), ("validation", 1), ("test", 2))}


def test_exact_ks_equals_enumeration():
    """All orders of two samples of up to 8 values each."""
    from fractions import Fraction
    from itertools import combinations

    from tessera.functions.stats import ks_exact

    for n in range(1, 9):
        for m in range(1, 9):
            if n + m > 13:
                continue
            seen = {}
            for first in combinations(range(n + m), n):
                own, i, j, d = set(first), 0, 0, Fraction(0)
                for k in range(n + m):
                    i, j = (i + 1, j) if k in own else (i, j + 1)
                    d = max(d, abs(Fraction(i, n) - Fraction(j, m)))
                seen[d] = seen.get(d, 0) + 1
            total, at_least = sum(seen.values()), 0
            for d in sorted(seen, reverse=True):
                at_least += seen[d]
                assert abs(ks_exact(float(d), n, m) - at_least / total) < 1e-12
    assert ks_exact(1.0, 8, 8) == pytest.approx(2 / math.comb(16, 8), rel=1e-12)
    assert ks_exact(0.0, 5, 7) == 1.0


def test_exact_ks_of_larger_samples():
    """Close to the asymptotic series where that is good, and to all digits in the tail."""
    from tessera.functions.stats import ks_exact

    for n, m, d in ((3000, 2000, 0.04), (5000, 5000, 0.02), (10_000, 9_000, 0.02)):
        lam = d * math.sqrt(n * m / (n + m))
        series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
        assert abs(ks_exact(d, n, m) - series) < 0.02
    assert ks_exact(1.0, 40, 50) == pytest.approx(2 / math.comb(90, 40), rel=1e-9)


def test_ks_method(spark):
    from tessera.operators import drift as D

    ref = spark.createDataFrame([(float(i),) for i in range(6)], "x double")
    cur = spark.createDataFrame([(float(i) + 10,) for i in range(5)], "x double")
    st = D.stack_sides(ref, cur)
    auto, exact, series = (D.ks_test(st, ["x"], method=m).first().p_value for m in ("auto", "exact", "asymptotic"))
    assert auto == exact == pytest.approx(2 / math.comb(11, 5)) and series != exact
    with pytest.raises(ValueError):
        D.ks_test(st, ["x"], method="other")
    none = D.ks_test(D.stack_sides(ref, cur.where("false")), ["x"]).first()
    assert none.p_value is None and not none.drift_detected


def test_sparse_one_hot_as_the_wide_one(spark):
    from tessera.operators import features as FE

    fit = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    df = spark.createDataFrame([("a",), ("b",), (None,), ("new",)], "c string")
    wide = FE.onehot_encode(df, "c", "hot", fit).select("c", "hot").collect()
    got = {r.c: (r.hot.size, r.hot.indices) for r in FE.onehot_sparse(df, "c", "hot", fit).collect()}
    assert got == {"a": (3, [0]), "b": (3, [1]), None: (3, [2]), "new": (3, [])} and len(wide) == 4
    many = spark.range(25_000).selectExpr("cast(id as string) as c")
    out = FE.onehot_sparse(many, "c", "hot")
    assert out.agg(F.count_distinct(F.col("hot.indices")[0]), F.max("hot.size")).first() == (25_000, 25_000)
    assert FE.onehot_sparse(fit.where("false"), "c", "hot").count() == 0


def test_confusion_counts_of_many_labels(spark):
    df = spark.createDataFrame([(i % 3000, (i * 7) % 3000 if i % 2 else i % 3000) for i in range(9000)] + [(None, 1), (1, None)], "a int, p int")
    got = {(r.actual, r.predicted): r for r in MT.confusion_counts(df, "a", "p").collect()}
    assert sum(r.n for r in got.values()) == 9000 and all(0 < r.recall_share <= 1 and 0 < r.precision_share <= 1 for r in got.values())
    rows = {}
    for (a, _), r in got.items():
        rows[a] = rows.get(a, 0) + r.recall_share
    assert len(rows) == 3000 and all(math.isclose(v, 1) for v in rows.values())
    assert MT.confusion_counts(df.where("false"), "a", "p").count() == 0


def test_exact_ks_in_one_go_as_one_by_one():
    """Tests of mixed sizes in one call; the tail keeps its digits."""
    from tessera.functions.stats import ks_exact, ks_exact_all

    r = np.random.default_rng(3)
    n, m = r.integers(1, 90, 200), r.integers(1, 90, 200)
    d = np.array([r.integers(0, a * b + 1) / (a * b) for a, b in zip(n, m, strict=True)])
    assert ks_exact_all(d, n, m) == pytest.approx([ks_exact(*x) for x in zip(d.tolist(), n.tolist(), m.tolist(), strict=True)], rel=1e-12, abs=0)
    assert ks_exact(1.0, 40, 50) == pytest.approx(2 / math.comb(90, 40), rel=1e-9, abs=0)


def test_keyed_exact_ks_is_dealt_out(spark):
    from tessera.operators import drift as D

    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "6")
    rows = own.createDataFrame([(k, float((i * 7 + k) % 11)) for k in range(20) for i in range(10)], "k long, x double")
    out = D.data_drift(rows, rows.withColumn("x", F.col("x") + 1), ["x"], with_psi=False, keys=["k"], method="exact")
    assert out.rdd.getNumPartitions() == 6 and out.where("p_value between 0 and 1").count() == 20
