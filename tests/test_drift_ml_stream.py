"""Drift, features, ML and streaming behaviour; streaming = batch on closed windows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tessera.operators import drift as D
from tessera.operators import features as FE
from tessera.operators import ml as ML
from tessera.sources import churn as CH
from tessera.sources import datasets as DS
from tessera.sources.tables import load


def test_ks_statistic_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=300).round(2), (rng.normal(size=200) + 0.3).round(2)
    ref = spark.createDataFrame([(float(v),) for v in a], "x double")
    cur = spark.createDataFrame([(float(v),) for v in b], "x double")
    got = D.ks_test(D.stack_sides(ref, cur), ["x"]).first()
    grid = np.union1d(a, b)
    d = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / 300 - np.searchsorted(np.sort(b), grid,
                                                                                         "right") / 200))
    assert math.isclose(got.statistic, d) and got.drift_detected == (got.p_value < 0.1)


def test_chi_square_new_category_is_infinite(spark):
    ref = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5, "c string")
    cur = spark.createDataFrame([("a",)] * 5 + [("z",)] * 5, "c string")
    got = D.chi_square_test(D.stack_sides(ref, cur), ["c"]).first()
    assert got.statistic == float("inf") and got.p_value == 0.0 and got.drift_detected


def test_chi_square_statistic(spark):
    ref = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "c string")
    cur = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10, "c string")
    got = D.chi_square_test(D.stack_sides(ref, cur), ["c"]).first()
    # expected 20/20: (10² + 10²) / 20 = 10; p = P(χ²₁ > 10) = erfc(sqrt(5))
    assert math.isclose(got.statistic, 10.0) and math.isclose(got.p_value, math.erfc(math.sqrt(5)), abs_tol=1e-7)


def test_psi_zero_for_identical_and_positive_for_shift(spark):
    li = load(spark, SF_SMALL, "lineitem").select("l_extendedprice")
    same = D.psi(D.stack_sides(li, li), ["l_extendedprice"]).first().psi
    shifted = D.psi(D.stack_sides(li, li.withColumn("l_extendedprice", F.col("l_extendedprice") * 1.5)),
                    ["l_extendedprice"]).first().psi
    assert abs(same) < 1e-12 and shifted > 0.1


def test_data_drift_detects_scaled_column(spark):
    li = load(spark, SF_SMALL, "lineitem").select("l_quantity", "l_returnflag")
    cur = li.withColumn("l_quantity", F.col("l_quantity") * 3)
    rows = {r.feature: r for r in D.data_drift(li, cur).collect()}
    assert rows["l_quantity"].drift_detected and not rows["l_returnflag"].drift_detected
    summary = D.drift_summary(D.data_drift(li, cur)).first()
    assert summary.features_drifted == 1 and summary.drift_detected


def test_binning_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5, 6, 100]] + [(None,)], "x double")
    out = FE.quantile_bin(df, "x", "b", q=4).collect()
    codes = {r.x: r.b for r in out}
    assert codes[None] is None and codes[1.0] == 0 and codes[100.0] == 2
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert all(r.b is None for r in FE.quantile_bin(const, "x", "b", q=4).collect())


def test_label_encode_unseen_raises(spark):
    fit = spark.createDataFrame([("a",), ("b",)], "c string")
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    assert [r.code for r in FE.label_encode(fit, "c", "code").orderBy("c").collect()] == [0, 1]
    with pytest.raises(Exception):
        FE.label_encode(new, "c", "code", fit_df=fit).collect()


def test_engineer_features_dependency_order(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (8.0,)], "x double")
    defs = [FE.FeatureDef("y2", "derived", "y", "square", dependencies=["y"]),
            FE.FeatureDef("y", "derived", "x", "sqrt")]
    out, added = FE.engineer_features(df, defs)
    assert added == ["y", "y2"]
    assert np.allclose(sorted(r.y2 for r in out.collect()), [1.0, 3.0, 8.0])


def test_feature_transformer_estimator(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    model = FE.FeatureTransformer(inputCol="x", outputCol="z", method="standard").fit(df)
    z = [r.z for r in model.transform(df).collect()]
    assert math.isclose(z[0], -1.224744871391589) and z[3] == 0.0


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_checksum_and_split_invariance(spark, parts):
    o = load(spark, SF_SMALL, "orders")
    base = DS.checksum(o).first().checksum
    assert DS.checksum(o.repartition(parts)).first().checksum == base
    s1 = {(r.o_orderkey, r.split) for r in ML.stratified_split(o, "o_orderstatus", ["o_orderkey"]).collect()}
    s2 = {(r.o_orderkey, r.split) for r in
          ML.stratified_split(o.repartition(parts), "o_orderstatus", ["o_orderkey"]).collect()}
    assert s1 == s2


def test_stratified_split_shares_are_exact(spark):
    o = load(spark, SF_SMALL, "orders")
    s = ML.stratified_split(o, "o_orderstatus", ["o_orderkey"], 0.7, 0.15)
    counts = {(r.o_orderstatus, r.split): r["count"] for r in s.groupBy("o_orderstatus", "split").count().collect()}
    totals = {r.o_orderstatus: r["count"] for r in o.groupBy("o_orderstatus").count().collect()}
    for st, n in totals.items():
        assert counts[(st, "train")] == math.floor(n * 0.7)


@pytest.mark.parametrize("parts", [1, 4])
def test_churn_generator_is_partition_free(spark, parts):
    c = load(spark, SF_SMALL, "customer")
    a = CH.generate_churn(c, "c_custkey").orderBy("customer_id").collect()
    b = CH.generate_churn(c.repartition(parts), "c_custkey").orderBy("customer_id").collect()
    assert a == b and len(a) == c.count() and len(a[0]) == 21
    rate = sum(r.churn for r in a) / len(a)
    assert 0.05 < rate < 0.6 and all(1 <= r.tenure <= 72 for r in a)


def test_linear_contributions_sum_to_logit(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "a double, b double")
    ex = ML.linear_contributions(df, {"a": 2.0, "b": -1.0}, 0.5, {"a": 2.0, "b": 1.0}).collect()
    for r in ex:
        total = r.baseline + sum(c.contribution for c in r.contributions)
        logit = 0.5 + 2.0 * r.a - 1.0 * r.b
        assert math.isclose(total, logit)
        assert abs(r.contributions[0].contribution) >= abs(r.contributions[1].contribution)


def test_train_and_score_logistic(spark):
    emb = load(spark, SF_SMALL, "embeddings")
    data = emb.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(4)],
                      (F.col("label") < 5).cast("int").alias("y"))
    r = ML.train_pipeline(data, "y", ["vec_id"], [f"e{i}" for i in range(4)], (), "logistic_regression", 2, 2)
    assert r.status == "completed" and 0 <= r.metrics["accuracy"] <= 1
    scored = ML.batch_score(r.model, data.withColumn("e0", F.when(F.col("vec_id") != 0, F.col("e0"))),
                            [f"e{i}" for i in range(4)], "vec_id")
    st = {x.status: x["count"] for x in scored.groupBy("status").count().collect()}
    assert st["failed"] == 1 and st["ok"] == data.count() - 1


def test_stream_counts_equal_batch_on_closed_windows(spark):
    from tessera.plans import stream_q
    from tessera.plans.mappings import predictions
    out = stream_q.stream_prediction_counts(spark, SF_SMALL)
    batch = (predictions(spark, SF_SMALL)
             .groupBy(F.window("timestamp", "1 minute").alias("w"), "model_name", "model_version", "status")
             .count())
    wm = load(spark, SF_SMALL, "events").agg(F.max("ts")).first()[0]
    import datetime
    wm = wm.replace(microsecond=wm.microsecond // 1000 * 1000) - datetime.timedelta(minutes=10)
    closed = batch.where(F.col("w.end") <= F.lit(wm))
    assert out.count() == closed.count()
    assert out.agg(F.sum("n")).first()[0] == closed.agg(F.sum("count")).first()[0]


def _requests():
    """(ts in ms, key, id) out of order within the watermark's delay, two at one instant."""
    import random as R

    rng = R.Random(11)
    rows = [(rng.randrange(0, 4_000_000), rng.choice("abc"), i) for i in range(120)] + [(500_000, "a", 900), (500_000, "a", 901)]
    return sorted(rows, key=lambda r: r[0] + rng.randrange(0, 400_000))


def _cached_by_hand(rows, ttl_ms, before):
    out, stored = {}, {}
    for t, k, i in sorted(rows, key=lambda r: (r[0], r[2])):
        if t < before:
            hit = k in stored and t - stored[k] < ttl_ms
            if not hit:
                stored[k] = t
            out[i] = hit
    return out


@pytest.mark.parametrize("files", [1, 5])
def test_prediction_cache_for_any_batches(spark, tmp_path, files):
    from tessera.streaming import io as SIO
    from tessera.streaming import monitors as MON

    rows = _requests()
    schema = "ms long, key string, prediction_id long"
    for f in range(files):
        part = rows[f * len(rows) // files:(f + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{f}"))
    s = (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
         .parquet(str(tmp_path / "in")).withColumn("timestamp", F.timestamp_millis("ms")))
    got = SIO.run_available_now(MON.prediction_cache(s, "key", 300, "10 minutes"), "cache-test").collect()
    want = _cached_by_hand(rows, 300_000, max(r[0] for r in rows) - 600_000)
    assert {r.prediction_id: r.cached for r in got} == want


def test_search_sees_training_rows_only(spark, monkeypatch):
    rows = [(i, float(i % 7), float((i * 3) % 5), int((i % 7) > 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    seen = {}
    real = ML.tune

    def spy(train, *args, **kw):
        seen["ids"] = {r.id for r in train.select("id").collect()}
        return real(train, *args, **kw)

    monkeypatch.setattr(ML, "tune", spy)
    r = ML.train_pipeline(df, "y", ["id"], ["a", "b"], (), "logistic_regression", 2, 2, metric="accuracy",
                          test_size=0.2, validation_size=0.1)
    assert r.status == "completed", r.error
    split = ML.stratified_split(ML.with_label(df, "y"), "label", ["id"], 0.7, 0.1)
    assert seen["ids"] == {x.id for x in split.where("split = 'train'").collect()}
    confusion = {k: v for k, v in r.metrics.items() if k.startswith("confusion_")}
    assert sum(confusion.values()) == r.metrics["prediction_count"] == split.where("split = 'test'").count()
    assert "cv_accuracy" in r.metrics


def test_unknown_metric_and_depth_are_refused(spark):
    with pytest.raises(ValueError):
        ML.evaluator_for("speed")
    with pytest.raises(ValueError):
        ML.trainers()["random_forest"].build({"max_depth": 31})


def test_no_limit_unless_asked(spark):
    from tessera.operators import catalog as C

    df = spark.range(1500).select(F.concat(F.lit("m"), "id").alias("model_name"), F.lit("None").alias("model_stage"),
                                  F.col("id").alias("prediction_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"))
    assert C.filter_name_stage(df, "M", None, [F.col("prediction_id")]).count() == 1500
    assert C.prediction_log_scan(df).count() == 1500
    assert C.prediction_log_scan(df, limit=10).count() == 10


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tessera import session as SE

    class Conf:
        def get(self, *a):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://x:1"})()

    with pytest.raises(RuntimeError):
        SE.checkpoint_dir(Fake())


def test_drift_report_of_every_model_and_type(spark):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for m in ("a", "b", None):
        for i in range(400):  # the newest 50 rows of b and of no name are shifted in x, those of a are not
            new = i >= 350
            rows.append((f"{m}{i:03}", m, "v2" if new else "v1", t0 + datetime.timedelta(minutes=i),
                         float(i % 10) + (100.0 if new and m != "a" else 0.0), float(i % 2), "u" if i % 2 else "w"))
    log = spark.createDataFrame(rows + [("c0", "c", "v9", t0, None, None, None)],
                                "prediction_id string, model_name string, model_version string, "
                                "timestamp timestamp_ntz, x double, prediction double, actual string")
    ref = log.where(F.col("timestamp") < F.lit("2024-01-01 05:50:00").cast("timestamp_ntz"))
    types = {"data_drift": ["x", "prediction"], "prediction_drift": ["prediction"], "concept_drift": ["actual"],
             "feature_drift": ["x"]}
    got = {(r.model_name, r.drift_type): r for r in D.drift_report(ref, log, types, "2024-02-01", newest=50).collect()}
    assert set(got) == {(m, t) for m in ("a", "b", "c", None) for t in types}
    assert len({r.report_id for r in got.values()}) == 16
    for m in ("b", None):
        r = got[m, "data_drift"]
        assert r.drift_detected and r.drift_score == 0.5 and r.drifted_features == ["x"] and r.model_version == "v2"
        assert got[m, "feature_drift"].drift_detected and not got[m, "prediction_drift"].drift_detected
    assert not any(r.drift_detected for (m, _), r in got.items() if m in ("a", "c"))
    assert got["c", "data_drift"].n_features == 0 and got["a", "concept_drift"].n_features == 1
    # one model by itself has the same checks
    alone = D.data_drift(ref.where("model_name = 'b'"), log.where("model_name = 'b'"), ["x", "actual"]).orderBy("feature")
    keyed = D.data_drift(ref, log, ["x", "actual"], keys=["model_name"]).where("model_name = 'b'").drop("model_name")
    for k, a in zip(keyed.select(alone.columns).orderBy("feature").collect(), alone.collect(), strict=True):
        assert all(x == pytest.approx(y) if isinstance(y, float) else x == y for x, y in zip(k, a))


def test_codes_of_few_categories_go_to_the_rows(spark):
    """A join by value would put a category's rows into one task."""
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = own.createDataFrame([(i, "b" if i % 10 else None) for i in range(50)], "id long, v string")
    for out in (FE.label_encode(df, "v", "code"), FE.onehot_sparse(df, "v", "code")):
        plan = out._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin [__v" not in plan
    assert {(r.v, r.code) for r in FE.label_encode(df, "v", "code").collect()} == {("b", 0), (None, 1)}
