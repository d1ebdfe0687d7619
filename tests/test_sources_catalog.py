"""Sources, catalog events and decisions on hand-made frames."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import decide as DC
from tessera.session import scratch_path
from tessera.sources import files as FS


def test_json_object_of_columns(spark):
    path = scratch_path(spark, "json-cols")
    doc = {"a": [1, 2, 3], "b": ["x", "y", "z"]}
    spark.createDataFrame([(json.dumps(doc),)], "v string").coalesce(1).write.text(path)
    rows = FS.scan_json_columns(spark, path, "a array<bigint>, b array<string>").orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x"), (2, "y"), (3, "z")]


def test_scan_by_suffix_rejects_unknown(spark):
    with pytest.raises(ValueError):
        FS.scan_by_suffix(spark, "/data/table.xlsx")


def test_csv_round_trip_with_schema(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(1, "a;b", 2.5)], "k int, s string, x double").write.option("header", True) \
        .option("sep", "|").csv(path)
    r = FS.scan_csv(spark, path, "k int, s string, x double", sep="|").first()
    assert (r.k, r.s, r.x) == (1, "a;b", 2.5)


def test_stage_history_and_current(spark):
    ev = spark.createDataFrame(
        [("m", 1, "None", "2024-01-01 00:00:00", "registered"), ("m", 1, "Staging", "2024-01-02 00:00:00", "ok"),
         ("m", 1, "Production", "2024-01-03 00:00:00", "go"), ("m", 2, "None", "2024-01-04 00:00:00", "new")],
        "model_name string, model_version bigint, stage string, event_time string, comment string").withColumn(
        "event_time", F.col("event_time").cast("timestamp_ntz"))
    hist = C.stage_history(ev).where("model_version = 1").orderBy("event_time").collect()
    assert [(r.from_stage, r.to_stage) for r in hist] == [("None", "None"), ("None", "Staging"),
                                                          ("Staging", "Production")]
    cur = {r.model_version: r.current_stage for r in C.current_stage(ev).collect()}
    assert cur == {1: "Production", 2: "None"}
    prod = C.production_version(C.current_stage(ev)).first()
    assert prod.production_version == 1


def test_latest_per_key_breaks_ties_by_order_columns(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 0, 99), ("b", 5, 1)], "k string, t int, v int")
    got = {r.k: r.v for r in C.latest_per_key(df, ["k"], ["t", "v"]).collect()}
    assert got == {"a": 11, "b": 1}


def _reports(spark, rows):
    return spark.createDataFrame(rows, "report_id string, report_seq bigint, model_name string, drift_detected boolean, "
                                       "created_at string").withColumn("created_at",
                                                                       F.col("created_at").cast("timestamp_ntz"))


def test_retrain_decision_drift_schedule_none(spark):
    reps = _reports(spark, [("r1", 1, "a", True, "2024-01-30 00:00:00"),   # fresh detection
                            ("r2", 2, "b", True, "2024-01-20 00:00:00"),   # old detection
                            ("r3", 3, "c", False, "2024-01-30 00:00:00")])
    out = {r.model_name: r for r in DC.retrain_decision(reps, "2024-01-30 12:00:00").collect()}
    assert out["a"].should_retrain and out["a"].reason == "drift_detected" and out["a"].drift_report_id == "r1"
    assert not out["b"].should_retrain and out["b"].reason == "no_trigger"
    sched = {r.model_name: r for r in DC.retrain_decision(reps, "2024-01-30 12:00:00", scheduled=True).collect()}
    assert sched["b"].should_retrain and sched["b"].reason == "scheduled"


def test_retrain_decision_only_newest_ten(spark):
    rows = [(f"r{i}", i, "a", i == 0, "2024-01-30 00:00:00") for i in range(11)]  # the detection is 11th newest
    out = DC.retrain_decision(_reports(spark, rows), "2024-01-30 12:00:00").first()
    assert not out.should_retrain


def test_promote_decision_threshold_and_missing_production(spark):
    cand = spark.createDataFrame([("a", "r1", 0.80), ("b", "r2", 0.80), ("c", "r3", 0.90)],
                                 "model_name string, run_id string, f1_score double")
    prod = spark.createDataFrame([("a", 7, 0.785), ("b", 8, 0.795)],
                                 "model_name string, model_version bigint, f1_score double")
    out = {r.model_name: r.decision for r in DC.promote_decision(cand, prod).collect()}
    assert out == {"a": "promote", "b": "discard", "c": "discard"}


def test_foreach_batch_sink_is_idempotent(spark, tmp_path):
    from tessera.streaming import io as SIO
    src = scratch_path(spark, "fb-src")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(src)
    out = scratch_path(spark, "fb-out")
    stream = spark.readStream.schema("k int, v string").parquet(src)
    first = SIO.foreach_batch_append(stream, out, "fb").count()
    # a replayed batch 0 overwrites its own partition instead of duplicating it
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn("batch_id", F.lit(0)).write \
        .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)
    assert first == 2 and spark.read.parquet(out).count() == 2
