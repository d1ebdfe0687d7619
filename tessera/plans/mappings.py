"""The reference's log and catalog tables, played by the driver tables.

Each mapping is a Spark function over the driver tables plus the same table as a
DuckDB CTE, so oracle SQL can be written against identical inputs.  Timestamps
stay ``timestamp_ntz`` (as loaded) so both engines see the same wall-clock values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.common import tbl

# The platform's vocabularies.
DRIFT_TYPES = ("data_drift", "prediction_drift", "concept_drift", "feature_drift")
MODEL_TYPES = ("random_forest", "xgboost", "lightgbm", "logistic_regression", "neural_network")
STAGES = ("None", "Staging", "Production", "Archived")


# ---------------------------------------------------------------- predictions log (events)

def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction log: event → prediction, user → model, value → latency."""
    return predictions_from_events(tbl(spark, sf, "events"))


def predictions_from_events(e: DataFrame) -> DataFrame:
    """The prediction-log projection of an events frame (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("prediction_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_name"),
        F.concat(F.lit("v"), (F.col("user_id") % 2 + 1).cast("string")).alias("model_version"),
        F.col("props").alias("features"),
        (k % 2).cast("double").alias("prediction"),
        (k / 100.0).alias("probability"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("ts").alias("timestamp"),
        ((F.col("value") * 100).cast("bigint") % 2).cast("double").alias("actual"),
    )


PREDICTIONS_SQL = """
predictions as (
  select event_id as prediction_id, 'm' || cast(user_id % 5 as varchar) as model_name,
         'v' || cast(user_id % 2 + 1 as varchar) as model_version, props as features,
         cast(cast(json_extract_string(props, '$.k') as int) % 2 as double) as prediction,
         cast(json_extract_string(props, '$.k') as int) / 100.0 as probability,
         value as latency_ms, case when event_type = 'error' then 'error' else 'success' end as status,
         ts as "timestamp", cast(cast(trunc(value * 100) as bigint) % 2 as double) as actual
  from events)
"""


# ---------------------------------------------------------------- drift reports (events)

def drift_reports(spark: SparkSession, sf: str) -> DataFrame:
    """One report per event: type from the event type, score from the value."""
    e = tbl(spark, sf, "events")
    dtype = (F.when(F.col("event_type") == "view", DRIFT_TYPES[0])
             .when(F.col("event_type") == "click", DRIFT_TYPES[1])
             .when(F.col("event_type") == "signup", DRIFT_TYPES[2])
             .otherwise(DRIFT_TYPES[3]))
    score = F.round(F.col("value") / 500.0, 6)
    return e.select(
        F.concat(F.lit("drift-"), F.col("event_id").cast("string")).alias("report_id"),
        F.col("event_id").alias("report_seq"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_name"),
        F.concat(F.lit("v"), (F.col("user_id") % 2 + 1).cast("string")).alias("model_version"),
        dtype.alias("drift_type"),
        (score > 0.1).alias("drift_detected"),
        score.alias("drift_score"),
        F.lit(0.1).alias("threshold"),
        F.concat(F.lit("f"), (F.get_json_object("props", "$.k").cast("int") % 4).cast("string")).alias("feature_name"),
        F.col("ts").alias("created_at"),
    )


DRIFT_REPORTS_SQL = """
drift_reports as (
  select 'drift-' || cast(event_id as varchar) as report_id, event_id as report_seq,
         'm' || cast(user_id % 5 as varchar) as model_name, 'v' || cast(user_id % 2 + 1 as varchar) as model_version,
         case event_type when 'view' then 'data_drift' when 'click' then 'prediction_drift'
              when 'signup' then 'concept_drift' else 'feature_drift' end as drift_type,
         round(value / 500.0, 6) > 0.1 as drift_detected, round(value / 500.0, 6) as drift_score,
         0.1 as threshold,
         'f' || cast(cast(json_extract_string(props, '$.k') as int) % 4 as varchar) as feature_name,
         ts as created_at
  from events)
"""


# ---------------------------------------------------------------- alert configs (nation)

def alert_configs(spark: SparkSession, sf: str) -> DataFrame:
    n = tbl(spark, sf, "nation")
    dtype = F.element_at(F.array(*[F.lit(t) for t in DRIFT_TYPES]), (F.col("n_regionkey") % 4 + 1).cast("int"))
    return n.select(
        F.concat(F.lit("m"), (F.col("n_nationkey") % 5).cast("string")).alias("model_name"),
        dtype.alias("drift_type"),
        (F.lit(0.2) + F.col("n_regionkey") / 10.0).alias("threshold"),
        F.concat(F.lit("https://hooks.example/"), F.lower("n_name")).alias("webhook_url"),
        (F.col("n_nationkey") % 4 != 0).alias("enabled"),
    )


ALERT_CONFIGS_SQL = """
alert_configs as (
  select 'm' || cast(n_nationkey % 5 as varchar) as model_name,
         (['data_drift', 'prediction_drift', 'concept_drift', 'feature_drift'])[n_regionkey % 4 + 1] as drift_type,
         0.2 + n_regionkey / 10.0 as threshold, 'https://hooks.example/' || lower(n_name) as webhook_url,
         n_nationkey % 4 <> 0 as enabled
  from nation)
"""


# ---------------------------------------------------------------- model versions and runs (orders)

def model_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Model registry: customer → model, order → version, status → stage."""
    o = tbl(spark, sf, "orders")
    stage = (F.when(F.col("o_orderstatus") == "F", "Production")
             .when(F.col("o_orderstatus") == "O", "Staging").otherwise("Archived"))
    return o.select(
        F.concat(F.lit("model_"), F.col("o_custkey").cast("string")).alias("model_name"),
        F.col("o_orderkey").alias("model_version"),
        stage.alias("model_stage"),
        F.concat(F.lit("runs:/run-"), F.col("o_orderkey").cast("string")).alias("artifact_uri"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
    )


MODEL_VERSIONS_SQL = """
model_versions as (
  select 'model_' || cast(o_custkey as varchar) as model_name, o_orderkey as model_version,
         case o_orderstatus when 'F' then 'Production' when 'O' then 'Staging' else 'Archived' end as model_stage,
         'runs:/run-' || cast(o_orderkey as varchar) as artifact_uri, 'run-' || cast(o_orderkey as varchar) as run_id,
         o_orderdate as created_at
  from orders)
"""


def training_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs: one per order; F1 from the price; status P = failed (no metrics)."""
    o = tbl(spark, sf, "orders")
    mtype = F.element_at(F.array(*[F.lit(t) for t in MODEL_TYPES]),
                         F.substring("o_orderpriority", 1, 1).cast("int"))
    failed = F.col("o_orderstatus") == "P"
    # ratios that never terminate at the 7th decimal, so rounding is stable across engines
    f1 = F.col("o_totalprice") / (F.col("o_totalprice") + 250000.0)
    return o.select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderkey").alias("run_seq"),
        F.concat(F.lit("exp_"), (F.col("o_custkey") % 50).cast("string")).alias("experiment_name"),
        F.concat(F.lit("model_"), F.col("o_custkey").cast("string")).alias("model_name"),
        mtype.alias("model_type"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(~failed, f1).alias("f1_score"),
        F.when(~failed, F.col("o_totalprice") / (F.col("o_totalprice") + 300000.0)).alias("accuracy"),
        F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 90).cast("int"),
                                                    F.lit(0))).alias("completed_at"),
    )


TRAINING_RUNS_SQL = """
training_runs as (
  select 'run-' || cast(o_orderkey as varchar) as run_id, o_orderkey as run_seq,
         'exp_' || cast(o_custkey % 50 as varchar) as experiment_name,
         'model_' || cast(o_custkey as varchar) as model_name,
         (['random_forest', 'xgboost', 'lightgbm', 'logistic_regression', 'neural_network'])
           [cast(substr(o_orderpriority, 1, 1) as int)] as model_type,
         case when o_orderstatus = 'P' then 'failed' else 'completed' end as status,
         case when o_orderstatus <> 'P' then o_totalprice / (o_totalprice + 250000.0) end as f1_score,
         case when o_orderstatus <> 'P' then o_totalprice / (o_totalprice + 300000.0) end as accuracy,
         o_orderdate as started_at,
         o_orderdate + to_minutes(cast(o_orderkey % 90 as bigint)) as completed_at
  from orders)
"""


# ---------------------------------------------------------------- scored documents (labels ⋈ documents)

def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions over documents (threshold on length) -- the predictions side of J1."""
    d = tbl(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("prediction_id"),
                    (F.col("n_chars") > 2000).cast("int").alias("prediction"),
                    F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("probability"))


def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    lb = tbl(spark, sf, "labels")
    return lb.select(F.col("doc_id").alias("prediction_id"), F.col("quality").alias("actual"))


# ---------------------------------------------------------------- lineitem as actual vs predicted

def lineitem_scored(spark: SparkSession, sf: str) -> DataFrame:
    li = tbl(spark, sf, "lineitem")
    q3 = (F.col("l_quantity") % 3).cast("int")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_returnflag").alias("actual"),
        F.when(q3 == 0, "A").when(q3 == 1, "N").otherwise("R").alias("predicted"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
        (F.col("l_discount") * 10).alias("score"),
    )


LINEITEM_SCORED_SQL = """
lineitem_scored as (
  select l_orderkey, l_linenumber, l_returnflag as actual,
         case cast(l_quantity % 3 as int) when 0 then 'A' when 1 then 'N' else 'R' end as predicted,
         cast(l_linestatus = 'F' as int) as label, l_discount * 10 as score
  from lineitem)
"""


# ---------------------------------------------------------------- feature registry (part)

def feature_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Feature sets: brand → set name, part → version, words of the name → features."""
    p = tbl(spark, sf, "part")
    words = F.split(F.col("p_name"), " ")
    feats = F.transform(words, lambda w: F.struct(
        w.alias("name"), F.lit("").alias("description"), F.lit("numeric").alias("feature_type"),
        w.alias("source_column"), F.lit(None).cast("string").alias("transformation"),
        F.create_map().cast("map<string,string>").alias("parameters"),
        F.array().cast("array<string>").alias("dependencies"),
        F.create_map().cast("map<string,string>").alias("tags")))
    return p.select(
        F.concat(F.lit("fs_"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))).alias("feature_set_name"),
        F.col("p_partkey").alias("version"),
        feats.alias("features"),
        F.col("p_type").alias("base_dataset"),
        F.lit("v1").alias("base_version"),
        F.timestamp_add("MINUTE", F.col("p_partkey"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("created_at"),
    )


FEATURE_REGISTRY_SQL = """
feature_registry as (
  select 'fs_' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) as feature_set_name,
         p_partkey as version, string_split(p_name, ' ') as words, p_type as base_dataset,
         timestamp '2024-01-01 00:00:00' + to_minutes(p_partkey) as created_at
  from part)
"""
