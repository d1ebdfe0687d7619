"""Retrain / promote decisions computed from run and report tables.

The reference makes these choices one HTTP call at a time for one model; here
each is a grouped query over all models at once, so a scheduler only has to act
on the rows it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import latest_per_key

PROMOTION_MIN_IMPROVEMENT = 0.01
RECENT_REPORTS = 10


def retrain_decision(reports: DataFrame, as_of, scheduled: bool = False, recent: int = RECENT_REPORTS,
                     max_age_days: int = 1) -> DataFrame:
    """Per model: retrain if one of its ``recent`` newest reports is a detection younger
    than ``max_age_days`` whole days (as of ``as_of``); else if the schedule flag is set.

    The newest-k per model is ``row_number() <= k``, which Spark limits per task
    before the shuffle.  Output follows the retraining-trigger record.
    """
    from pyspark.sql import Window

    now = F.lit(as_of).cast("timestamp_ntz")
    w = Window.partitionBy("model_name").orderBy(F.col("created_at").desc(), F.col("report_seq").desc())
    top = reports.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= recent)
    # whole days of age, floored like a timedelta's .days (negative ages count as fresh)
    age_days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")))
                       / 86_400_000_000)
    fresh = F.col("drift_detected") & (age_days < max_age_days)
    agg = top.groupBy("model_name").agg(
        F.bool_or(fresh).alias("recent_drift"),
        F.max_by(F.when(fresh, F.col("report_id")), F.when(fresh, F.struct("created_at", "report_seq")))
        .alias("drift_report_id"))
    ttype = (F.when(F.col("recent_drift"), "drift").when(F.lit(scheduled), "schedule").otherwise("none"))
    reason = (F.when(F.col("recent_drift"), "drift_detected").when(F.lit(scheduled), "scheduled")
              .otherwise("no_trigger"))
    return agg.select(
        F.concat(F.lit("trigger-"), F.substring(F.sha2(F.concat_ws("|", "model_name", now.cast("string")), 256), 1,
                                                12)).alias("trigger_id"),
        ttype.alias("trigger_type"), "model_name", reason.alias("reason"),
        F.when(F.col("recent_drift"), F.col("drift_report_id")).alias("drift_report_id"),
        F.lit("system").alias("triggered_by"), now.alias("triggered_at"),
        (F.col("recent_drift") | F.lit(scheduled)).alias("should_retrain"))


def candidate_vs_production(candidates: DataFrame, production: DataFrame, metric: str = "f1_score"
                            ) -> DataFrame:
    """Candidate metrics beside the production version's (J9): left join by model."""
    prod = production.select("model_name", F.col(metric).alias("current_" + metric),
                             F.col("model_version").alias("production_version"))
    return candidates.join(prod, "model_name", "left")


def promote_decision(candidates: DataFrame, production: DataFrame, metric: str = "f1_score",
                     min_improvement: float = PROMOTION_MIN_IMPROVEMENT) -> DataFrame:
    """Promote when new − current > ``min_improvement`` (missing metrics count 0);
    a model without a production version is discarded, as in the reference."""
    j = candidate_vs_production(candidates, production, metric)
    new = F.coalesce(F.col(metric), F.lit(0.0))
    cur = F.coalesce(F.col("current_" + metric), F.lit(0.0))
    improvement = new - cur
    has_prod = F.col("production_version").isNotNull()
    return j.select(
        "model_name", "run_id", F.col("production_version"), new.alias("new_" + metric),
        cur.alias("current_" + metric), improvement.alias("improvement"),
        F.when(has_prod & (improvement > min_improvement), "promote").otherwise("discard").alias("decision"))


def promotion_events(decisions: DataFrame, versions: DataFrame, at) -> DataFrame:
    """Stage events for the promoted candidates (append to the stage-event table): the version
    registered for the candidate's run goes to Production, the one it replaces to Archived.
    A promoted run without a registered version gives no event."""
    reg = versions.select("model_name", "run_id", "model_version")
    win = decisions.where(F.col("decision") == "promote").join(reg, ["model_name", "run_id"])
    event = F.array(F.struct(F.col("model_version").alias("model_version"), F.lit("Production").alias("stage"),
                             F.lit("automated promotion").alias("comment")),
                    F.struct(F.col("production_version").alias("model_version"), F.lit("Archived").alias("stage"),
                             F.lit("replaced by promotion").alias("comment")))
    return (win.select("model_name", F.col("production_version").alias("__old"), F.col("model_version").alias("__new"),
                       F.inline(event))
            .where((F.col("stage") == "Production") | (F.col("__old") != F.col("__new")))
            .select("model_name", "model_version", "stage", F.lit(at).cast("timestamp_ntz").alias("event_time"), "comment"))


def drift_alerts(reports: DataFrame, configs: DataFrame) -> DataFrame:
    """Detected reports with an enabled config of the same model and drift type whose
    threshold the score exceeds (J3).

    Alert configs are keyed by (model, drift type), so the table is bounded by
    models × drift types; the join is an equi-join that AQE broadcasts when the
    config side is small and shuffles otherwise.
    """
    cfg = configs.where("enabled").select("model_name", "drift_type", F.col("threshold").alias("alert_threshold"),
                                          "webhook_url")
    det = reports.where("drift_detected")
    j = det.join(cfg, ["model_name", "drift_type"]).where(F.col("drift_score") > F.col("alert_threshold"))
    return j.select(F.lit("drift_detected").alias("alert_type"), "report_id", "model_name", "model_version",
                    "drift_type", "drift_score", "alert_threshold", "webhook_url", "created_at")


def latest_training_input(versions: DataFrame, order: list[str]) -> DataFrame:
    """Newest dataset version (W1 over the version table, all datasets at once)."""
    return latest_per_key(versions, ["dataset_name"], order)
