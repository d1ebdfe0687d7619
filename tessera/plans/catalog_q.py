"""Catalog queries: versions, stages, runs, feature sets, lookups (W1, W2, T1, T2, T4, J2, J4,
A23, P4–P6, P12, S12, S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.plans import mappings as M
from tessera.plans.common import query, tbl


@query("latest_version", "with " + M.MODEL_VERSIONS_SQL + """
select model_name, model_version, model_stage, created_at from (
  select *, row_number() over (partition by model_name order by created_at desc, model_version desc) rn
  from model_versions) where rn = 1
""")
def latest_version(spark, sf):
    v = M.model_versions(spark, sf)
    return C.latest_per_key(v, ["model_name"], ["created_at", "model_version"]).select(
        "model_name", "model_version", "model_stage", "created_at")


@query("latest_feature_set", "with " + M.FEATURE_REGISTRY_SQL + """
select feature_set_name, version, cast(len(words) as int) as n_features, created_at from (
  select *, row_number() over (partition by feature_set_name order by created_at desc, version desc) rn
  from feature_registry) where rn = 1
""")
def latest_feature_set(spark, sf):
    fr = M.feature_registry(spark, sf)
    return C.latest_per_key(fr, ["feature_set_name"], ["created_at", "version"]).select(
        "feature_set_name", "version", F.size("features").alias("n_features"), "created_at")


@query("feature_set_counts", "with " + M.FEATURE_REGISTRY_SQL + """
select feature_set_name, version, cast(len(words) as int) as n_features, created_at from feature_registry
""")
def feature_set_counts(spark, sf):
    fr = M.feature_registry(spark, sf)
    return fr.select("feature_set_name", "version", F.size("features").alias("n_features"), "created_at").orderBy(
        F.col("created_at").desc())


STAGE_EVENTS_SQL = M.MODEL_VERSIONS_SQL + """,
stage_events as (
  select model_name, model_version, 'None' as stage, created_at as event_time, 'registered' as comment
  from model_versions
  union all select model_name, model_version, 'Staging', created_at + interval 1 hour, 'validation'
  from model_versions
  union all select model_name, model_version, model_stage, created_at + interval 1 day, 'to ' || model_stage
  from model_versions where model_stage not in ('None', 'Staging'))
"""


@query("stage_transition", "with " + STAGE_EVENTS_SQL + """
select model_name, model_version, to_stage, event_time, comment,
       coalesce(lag(to_stage) over (partition by model_name, model_version order by event_time), 'None') from_stage
from (select model_name, model_version, stage as to_stage, event_time, comment from stage_events)
""")
def stage_transition(spark, sf):
    ev = C.stage_events_from_versions(M.model_versions(spark, sf))
    return C.stage_history(ev)


@query("production_version", "with " + STAGE_EVENTS_SQL + """,
cur as (select model_name, model_version, stage, event_time from (
          select *, row_number() over (partition by model_name, model_version order by event_time desc) rn
          from stage_events) where rn = 1)
select m.model_name, p.production_version from (select distinct model_name from model_versions) m
left join (select model_name, arg_max(model_version, (event_time, model_version)) production_version from cur
           where stage = 'Production' group by model_name) p on p.model_name = m.model_name
""")
def production_version(spark, sf):
    v = M.model_versions(spark, sf)
    cur = C.current_stage(C.stage_events_from_versions(v))
    return C.production_version(cur, v)


@query("serving_version", "with " + STAGE_EVENTS_SQL + """,
cur as (select model_name, model_version, stage, event_time from (
          select *, row_number() over (partition by model_name, model_version order by event_time desc) rn
          from stage_events) where rn = 1),
best as (select *, row_number() over (partition by model_name
                                      order by stage = 'Production' desc, event_time desc, model_version desc) r
         from cur where stage in ('Production', 'None'))
select m.model_name, b.model_version serving_version, b.stage
from (select distinct model_name from cur) m left join best b on b.model_name = m.model_name and b.r = 1
""")
def serving_version(spark, sf):
    """Production, falling back to a version in no stage yet."""
    v = M.model_versions(spark, sf)
    return C.serving_version(C.current_stage(C.stage_events_from_versions(v)))


@query("recent_runs", "with " + M.TRAINING_RUNS_SQL + """
select run_id, experiment_name, model_type, status, round(f1_score, 6) f1_score, started_at from training_runs
order by started_at desc, run_seq desc limit 100
""")
def recent_runs(spark, sf):
    r = M.training_runs(spark, sf)
    return C.top_n(r, [F.col("started_at").desc(), F.col("run_seq").desc()], 100).select(
        "run_id", "experiment_name", "model_type", "status", F.round("f1_score", 6).alias("f1_score"),
        "started_at")


@query("rank_models", "with " + M.TRAINING_RUNS_SQL + """,
ranked as (select *, row_number() over (partition by experiment_name
                                        order by coalesce(f1_score, 0) desc, run_seq asc) rk,
                  count(*) over (partition by experiment_name) n_runs
           from training_runs)
select experiment_name, case when status = 'completed' then run_id end as best_run_id,
       case when status = 'completed' then model_type end as best_model_type,
       round(coalesce(f1_score, 0), 6) as top_f1, n_runs
from ranked where rk = 1
""")
def rank_models(spark, sf):
    r = M.training_runs(spark, sf).withColumn("score", F.coalesce("f1_score", F.lit(0.0)))
    top = C.latest_per_key(r.withColumn("neg_seq", -F.col("run_seq")), ["experiment_name"], ["score", "neg_seq"])
    counts = r.groupBy("experiment_name").agg(F.count(F.lit(1)).alias("n_runs"))
    ok = F.col("status") == "completed"
    return top.join(counts, "experiment_name").select(
        "experiment_name", F.when(ok, F.col("run_id")).alias("best_run_id"),
        F.when(ok, F.col("model_type")).alias("best_model_type"), F.round("score", 6).alias("top_f1"), "n_runs")


@query("head_tail", """
(select 'head' as side, event_id, ts from events order by ts, event_id limit 50)
union all
(select 'tail', event_id, ts from events order by ts desc, event_id desc limit 50)
""")
def head_tail(spark, sf):
    e = tbl(spark, sf, "events").select("event_id", "ts")
    head = C.top_n(e, [F.col("ts"), F.col("event_id")], 50).withColumn("side", F.lit("head"))
    tail = C.top_n(e, [F.col("ts").desc(), F.col("event_id").desc()], 50).withColumn("side", F.lit("tail"))
    return head.unionByName(tail).select("side", "event_id", "ts")


@query("online_features", """
with ids as (select distinct o_custkey from orders where o_orderpriority = '1-URGENT')
select entity_id, o_orderkey, round(o_totalprice, 6) o_totalprice, o_orderstatus, o_orderdate from (
  select o_custkey entity_id, *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn
  from orders where o_custkey in (select o_custkey from ids)) where rn = 1
""")
def online_features(spark, sf):
    o = tbl(spark, sf, "orders").withColumnRenamed("o_custkey", "entity_id")
    ids = tbl(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    out = C.online_features(o, "entity_id", ["o_orderdate", "o_orderkey"], ids,
                            ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("version_metrics", "with " + M.MODEL_VERSIONS_SQL + "," + M.TRAINING_RUNS_SQL + """
select v.model_name, v.model_version, round(coalesce(r.f1_score, 0), 6) as f1_score
from model_versions v left join training_runs r on r.run_id = v.run_id
""")
def version_metrics(spark, sf):
    out = C.version_metrics(M.model_versions(spark, sf), M.training_runs(spark, sf), "f1_score")
    return out.select("model_name", "model_version", F.round("f1_score", 6).alias("f1_score"))


@query("filter_dynamic", "with " + M.DRIFT_REPORTS_SQL + """
select report_id, model_name, drift_type, drift_score, created_at from drift_reports
where model_name = 'm1' and drift_type = 'data_drift'
order by created_at desc, report_seq desc limit 20
""")
def filter_dynamic(spark, sf):
    r = M.drift_reports(spark, sf)
    out = C.filter_dynamic(r, {"model_name": "m1", "drift_type": "data_drift", "model_version": None},
                           [F.col("created_at").desc(), F.col("report_seq").desc()], 20)
    return out.select("report_id", "model_name", "drift_type", "drift_score", "created_at")


@query("filter_name_stage", "with " + M.MODEL_VERSIONS_SQL + """
select model_name, model_version, model_stage, created_at from model_versions
where contains(lower(model_name), 'model_1') and model_stage = 'Production'
order by created_at desc, model_version desc limit 100
""")
def filter_name_stage(spark, sf):
    v = M.model_versions(spark, sf)
    return C.filter_name_stage(v, "MODEL_1", "Production",
                               [F.col("created_at").desc(), F.col("model_version").desc()], 100).select(
        "model_name", "model_version", "model_stage", "created_at")


@query("filter_time_range", """
select event_id, ts from events
where ts >= timestamp '2024-01-30 00:00:00' - interval 7 day and ts <= timestamp '2024-01-30 00:00:00'
""")
def filter_time_range(spark, sf):
    e = tbl(spark, sf, "events")
    return C.filter_time_range(e, "ts", "2024-01-30 00:00:00", 7).select("event_id", "ts")


@query("lookup_key", "with " + M.MODEL_VERSIONS_SQL + """
select model_name, model_version, model_stage, count(*) over (partition by model_name) n_versions
from model_versions where model_name in ('model_1', 'model_7', 'model_99', 'model_nosuch')
""")
def lookup_key(spark, sf):
    v = M.model_versions(spark, sf)
    hit = C.lookup_keys(v, "model_name", ["model_1", "model_7", "model_99", "model_nosuch"])
    return C.count_per_key(hit, ["model_name"], "n_versions").select(
        "model_name", "model_version", "model_stage", "n_versions")


@query("prediction_log_scan", "with " + M.PREDICTIONS_SQL + """
select prediction_id, model_name, round(latency_ms, 6) latency_ms, "timestamp" from predictions
where model_name = 'm2' and "timestamp" >= timestamp '2024-01-10 00:00:00'
  and "timestamp" <= timestamp '2024-01-20 00:00:00'
order by "timestamp" desc, prediction_id desc limit 1000
""")
def prediction_log_scan(spark, sf):
    p = M.predictions(spark, sf)
    out = C.prediction_log_scan(p, "m2", "2024-01-10 00:00:00", "2024-01-20 00:00:00", 1000)
    return out.select("prediction_id", "model_name", F.round("latency_ms", 6).alias("latency_ms"), "timestamp")


@query("metadata_upsert", """
select entity_id, round(o_totalprice, 6) as value, o_orderdate as updated_at from (
  select o_custkey entity_id, *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn
  from orders) where rn = 1 and o_orderstatus <> 'P'
""")
def metadata_upsert(spark, sf):
    """Customer profile kept as change rows (orders); status P is a tombstone."""
    o = tbl(spark, sf, "orders")
    changes = o.select(F.col("o_custkey").alias("entity_id"), F.round("o_totalprice", 6).alias("value"),
                       F.struct("o_orderdate", "o_orderkey").alias("__ts"), F.col("o_orderdate").alias("updated_at"),
                       (F.col("o_orderstatus") == "P").alias("deleted"))
    return C.metadata_events(changes, ["entity_id"], "__ts").drop("__ts")
