"""Decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import decide as DC
from tessera.plans import mappings as M
from tessera.plans.common import query, round_doubles, tbl

AS_OF = "2024-01-30 12:00:00"


@query("retrain_decision", "with " + M.DRIFT_REPORTS_SQL + f""",
top as (select * from (
          select *, row_number() over (partition by model_name order by created_at desc, report_seq desc) rn
          from drift_reports) where rn <= 10),
f as (select *, drift_detected and floor((epoch_us(timestamp '{AS_OF}') - epoch_us(created_at)) / 86400000000) < 1
                 as fresh from top),
a as (select model_name, bool_or(fresh) recent_drift,
             arg_max(report_id, created_at) filter (where fresh) drift_report_id from f group by model_name)
select 'trigger-' || substr(sha256(model_name || '|' || cast(timestamp '{AS_OF}' as varchar)), 1, 12) trigger_id,
       case when recent_drift then 'drift' else 'none' end trigger_type, model_name,
       case when recent_drift then 'drift_detected' else 'no_trigger' end reason,
       case when recent_drift then drift_report_id end drift_report_id, 'system' triggered_by,
       timestamp '{AS_OF}' triggered_at, recent_drift should_retrain
from a
""")
def retrain_decision(spark, sf):
    return DC.retrain_decision(M.drift_reports(spark, sf), AS_OF, scheduled=False)


def _candidates(spark, sf):
    runs = M.training_runs(spark, sf).where(F.col("status") == "completed")
    return C.latest_per_key(runs.select("model_name", "run_id", "f1_score", "started_at", "run_seq"),
                            ["model_name"], ["started_at", "run_seq"]).select("model_name", "run_id", "f1_score")


def _production(spark, sf):
    v = M.model_versions(spark, sf).where(F.col("model_stage") == "Production")
    prod = C.latest_per_key(v.select("model_name", "model_version", "run_id", "created_at"), ["model_name"],
                            ["created_at", "model_version"])
    runs = M.training_runs(spark, sf).select("run_id", "f1_score")
    return C.version_metrics(prod, runs, "f1_score")


CAND_PROD_SQL = "with " + M.TRAINING_RUNS_SQL + "," + M.MODEL_VERSIONS_SQL + """,
cand as (select model_name, run_id, f1_score from (
           select *, row_number() over (partition by model_name order by started_at desc, run_seq desc) rn
           from training_runs where status = 'completed') where rn = 1),
prod as (select p.model_name, p.model_version, coalesce(r.f1_score, 0.0) f1_score from (
           select *, row_number() over (partition by model_name order by created_at desc, model_version desc) rn
           from model_versions where model_stage = 'Production') p
         left join training_runs r on r.run_id = p.run_id where p.rn = 1),
j as (select c.model_name, c.run_id, c.f1_score, p.f1_score current_f1_score, p.model_version production_version
      from cand c left join prod p on p.model_name = c.model_name)
"""


@query("candidate_vs_production", CAND_PROD_SQL + """
select model_name, run_id, round(f1_score, 6) f1_score, round(current_f1_score, 6) current_f1_score,
       production_version from j
""")
def candidate_vs_production(spark, sf):
    return round_doubles(DC.candidate_vs_production(_candidates(spark, sf), _production(spark, sf)))


@query("promote_decision", CAND_PROD_SQL + """
select model_name, run_id, production_version, round(coalesce(f1_score, 0), 6) new_f1_score,
       round(coalesce(current_f1_score, 0), 6) current_f1_score,
       round(coalesce(f1_score, 0) - coalesce(current_f1_score, 0), 6) improvement,
       case when production_version is not null and coalesce(f1_score, 0) - coalesce(current_f1_score, 0) > 0.01
            then 'promote' else 'discard' end decision
from j
""")
def promote_decision(spark, sf):
    return round_doubles(DC.promote_decision(_candidates(spark, sf), _production(spark, sf)))


@query("promotion_events", CAND_PROD_SQL + f""",
won as (select j.model_name, v.model_version, j.production_version from j
        join model_versions v on v.model_name = j.model_name and v.run_id = j.run_id
        where j.production_version is not null and coalesce(j.f1_score, 0) - coalesce(j.current_f1_score, 0) > 0.01)
select model_name, model_version, 'Production' stage, timestamp '{AS_OF}' event_time, 'automated promotion' "comment" from won
union all
select model_name, production_version, 'Archived', timestamp '{AS_OF}', 'replaced by promotion' from won
where production_version <> model_version
""")
def promotion_events(spark, sf):
    """R2, the registry's half: the candidate's registered version to Production, the old one to Archived."""
    d = DC.promote_decision(_candidates(spark, sf), _production(spark, sf))
    return DC.promotion_events(d, M.model_versions(spark, sf), AS_OF)


@query("drift_alerts", "with " + M.DRIFT_REPORTS_SQL + "," + M.ALERT_CONFIGS_SQL + """
select 'drift_detected' alert_type, r.report_id, r.model_name, r.model_version, r.drift_type, r.drift_score,
       c.threshold alert_threshold, c.webhook_url, r.created_at
from drift_reports r join alert_configs c on c.model_name = r.model_name and c.drift_type = r.drift_type
where r.drift_detected and c.enabled and r.drift_score > c.threshold
""")
def drift_alerts(spark, sf):
    return DC.drift_alerts(M.drift_reports(spark, sf), M.alert_configs(spark, sf))


def _dataset_versions(spark, sf):
    """lineitem published as monthly versions of one dataset: (dataset, version, rows)."""
    li = tbl(spark, sf, "lineitem")
    return (li.groupBy(F.lit("lineitem").alias("dataset_name"),
                       F.date_format("l_shipdate", "'v'yyyyMM").alias("version"))
            .agg(F.count(F.lit(1)).alias("row_count"), F.max("l_shipdate").alias("created_at")))


@query("latest_training_input", """
with v as (select strftime(l_shipdate, 'v%Y%m') version from lineitem),
latest as (select max(version) version from v)
select l_orderkey, l_linenumber, strftime(l_shipdate, 'v%Y%m') version, round(ln(1 + l_extendedprice), 6) log_price,
       round(l_quantity * l_quantity, 6) qty_sq
from lineitem where strftime(l_shipdate, 'v%Y%m') = (select version from latest)
""")
def latest_training_input(spark, sf):
    """The newest dataset version, read back from the version store, engineered by the
    feature set's newest definitions from the registry, and recorded."""
    from datetime import datetime

    from tessera.operators import features as FE
    from tessera.session import scratch_path
    from tessera.sources import datasets as DS

    at = datetime.fromisoformat(AS_OF)
    root, meta, registry, engineered = (scratch_path(spark, f"training-input-{n}") for n in ("versions", "meta", "registry", "engineered"))
    latest = DC.latest_training_input(_dataset_versions(spark, sf), ["version"])
    li = tbl(spark, sf, "lineitem").withColumn("version", F.date_format("l_shipdate", "'v'yyyyMM"))
    version = latest.first()["version"]
    DS.write_dataset_version(li.where(F.col("version") == version), root, "lineitem", version, metadata_table=meta)
    old = [FE.FeatureDef("log_price", "derived", "l_extendedprice", "sqrt")]
    new = [FE.FeatureDef("log_price", "derived", "l_extendedprice", "log"), FE.FeatureDef("qty_sq", "derived", "l_quantity", "square")]
    for v, defs in ((1, old), (2, new)):
        DS.metadata_append(FE.definition_rows(spark, "pricing", v, defs, at), registry)
    rows = DS.read_dataset_version(spark, root, "lineitem", metadata_table=meta)
    defs = FE.definitions(spark.read.parquet(registry), "pricing")
    record = FE.materialize_features(rows, defs, engineered, "lineitem", version, "pricing", at)
    out = spark.read.parquet(record.first()["path"])
    return out.select("l_orderkey", "l_linenumber", "version", F.round("log_price", 6).alias("log_price"),
                      F.round("qty_sq", 6).alias("qty_sq"))
