"""Monitoring metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as MT
from tessera.plans import mappings as M
from tessera.plans.common import query, r6, round_doubles, tbl
from tessera.session import scratch_path


@query("value_counts", "select event_type as value, count(*) as count from events group by event_type")
def value_counts(spark, sf):
    return MT.value_counts(tbl(spark, sf, "events"), "event_type")


@query("confusion_matrix", "with " + M.LINEITEM_SCORED_SQL + """,
labels as (select distinct actual l from lineitem_scored union select distinct predicted from lineitem_scored),
c as (select actual, predicted, count(*) n from lineitem_scored group by all)
select a.l as actual, p.l as predicted, coalesce(c.n, 0) as n
from labels a join labels p on true left join c on c.actual = a.l and c.predicted = p.l
""")
def confusion_matrix(spark, sf):
    return MT.confusion_matrix(M.lineitem_scored(spark, sf), "actual", "predicted")


CLASS_METRICS_SQL = """,
pairs as (select actual a, predicted p, count(*) n from lineitem_scored group by all),
per as (select cls, sum(support) support, sum(pn) pn, sum(tp) tp from (
          select a cls, n support, 0 pn, case when a = p then n else 0 end tp from pairs
          union all select p, 0, n, 0 from pairs) group by cls),
m as (select cls, support, tp, coalesce(tp / nullif(pn, 0), 0) prec, coalesce(tp / nullif(support, 0), 0) rec
      from per),
f as (select *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) f1 from m)
"""


@query("confusion_counts", """
with c as (select l_partkey actual, l_suppkey predicted, count(*) n from lineitem where l_partkey is not null and l_suppkey is not null group by all)
select actual, predicted, n, round(n / sum(n) over (partition by actual), 6) recall_share,
       round(n / sum(n) over (partition by predicted), 6) precision_share from c
""")
def confusion_counts(spark, sf):
    """A9 over as many labels as there are parts and suppliers: the cells that are not 0."""
    return round_doubles(MT.confusion_counts(tbl(spark, sf, "lineitem"), "l_partkey", "l_suppkey"))


@query("classification_metrics", "with " + M.LINEITEM_SCORED_SQL + CLASS_METRICS_SQL + """
select round(sum(tp) / sum(support), 6) accuracy, round(sum(prec * support) / sum(support), 6) "precision",
       round(sum(rec * support) / sum(support), 6) recall, round(sum(f1 * support) / sum(support), 6) f1_score,
       cast(sum(support) as bigint) prediction_count
from f
""")
def classification_metrics(spark, sf):
    return round_doubles(MT.classification_metrics(M.lineitem_scored(spark, sf), "actual", "predicted"))


@query("roc_auc", "with " + M.LINEITEM_SCORED_SQL + """,
s as (select score, sum(label)::double pos, sum(1 - label)::double neg from lineitem_scored group by score),
c as (select *, sum(neg) over (order by score rows between unbounded preceding and current row) cum_neg from s)
select round(sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) roc_auc,
       cast(sum(pos) as bigint) positives, cast(sum(neg) as bigint) negatives from c
""")
def roc_auc(spark, sf):
    return round_doubles(MT.roc_auc(M.lineitem_scored(spark, sf), "label", "score"))


@query("log_loss", "with " + M.LINEITEM_SCORED_SQL + """
select round(avg(case when label = 1 then -ln(least(greatest(score, 1e-15), 1 - 1e-15))
                      else -ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) end), 6) log_loss,
       count(*) n from lineitem_scored
""")
def log_loss(spark, sf):
    return round_doubles(MT.log_loss(M.lineitem_scored(spark, sf), "label", "score"))


@query("latency_summary", "with " + M.PREDICTIONS_SQL + """
select model_name, count(*) total_predictions, min("timestamp") "start", max("timestamp") "end",
       round(avg(latency_ms), 6) mean_ms, round(quantile_cont(latency_ms, 0.95), 6) p95_ms,
       round(quantile_cont(latency_ms, 0.99), 6) p99_ms
from predictions group by model_name
""")
def latency_summary(spark, sf):
    return round_doubles(MT.latency_summary(M.predictions(spark, sf), ["model_name"], "timestamp", "latency_ms"))


@query("latency_sketch_summary", "with " + M.PREDICTIONS_SQL + """
select model_name, count(*) total_predictions, min("timestamp") "start", max("timestamp") "end",
       round(avg(latency_ms), 6) mean_ms, true p95_close, true p99_close
from predictions group by model_name
""")
def latency_sketch_summary(spark, sf):
    """A13 from hourly sketches, stored and merged; the true ranks of the quantiles lie within three times the
    sketches' error."""
    from tessera.operators import sketches as SK
    p = M.predictions(spark, sf)
    path = scratch_path(spark, "latency-sketches")
    SK.latency_sketches(p, ["model_name"], "timestamp", "latency_ms").write.parquet(path)
    out = SK.merged_latency(spark.read.parquet(path), ["model_name"])
    below = p.join(out.select("model_name", "p95_ms", "p99_ms"), "model_name").groupBy("model_name").agg(
        *[F.avg((F.col("latency_ms") < F.col(c)).cast("double")).alias(f"lo_{c}") for c in ("p95_ms", "p99_ms")],
        *[F.avg((F.col("latency_ms") <= F.col(c)).cast("double")).alias(f"hi_{c}") for c in ("p95_ms", "p99_ms")])
    close = [((F.col(f"lo_{c}") <= q + 3 * F.col("rank_error")) & (F.col(f"hi_{c}") >= q - 3 * F.col("rank_error"))).alias(f"{c[:3]}_close")
             for c, q in (("p95_ms", 0.95), ("p99_ms", 0.99))]
    return round_doubles(out.join(below, "model_name").select("model_name", "total_predictions", "start", "end", "mean_ms", *close))


@query("prediction_counts", "with " + M.PREDICTIONS_SQL + """
select model_name, model_version, status, count(*) count from predictions group by all
""")
def prediction_counts(spark, sf):
    return MT.prediction_counts(M.predictions(spark, sf))


HIST_SQL = """,
b as (select unnest([0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 'inf'::double]) le),
h as (select model_name, model_version, le, count(*) filter (where latency_ms / 1000.0 <= le) count
      from predictions, b group by all)
"""


@query("latency_histogram", "with " + M.PREDICTIONS_SQL + HIST_SQL + """
select model_name, model_version, le, count from h
""")
def latency_histogram(spark, sf):
    return MT.latency_histogram(M.predictions(spark, sf))


@query("histogram_quantile", "with " + M.PREDICTIONS_SQL + HIST_SQL + """,
t as (select model_name, model_version, max(count) filter (where le = 'inf'::double) total from h group by all),
x as (select h.*, t.total, lag(le) over w prev_le, lag(count) over w prev_n,
             row_number() over (partition by h.model_name, h.model_version, (count >= 0.95 * total) order by le) rk
      from h join t using (model_name, model_version)
      window w as (partition by h.model_name, h.model_version order by le))
select model_name, model_version,
       round(case when le = 'inf'::double then 5.0
                  else coalesce(prev_le, 0) + (le - coalesce(prev_le, 0))
                       * coalesce((0.95::double * total - coalesce(prev_n, 0)) / nullif(count - coalesce(prev_n, 0), 0), 0)
             end, 6) as quantile
from x where count >= 0.95 * total and rk = 1
""")
def histogram_quantile(spark, sf):
    h = MT.latency_histogram(M.predictions(spark, sf))
    return round_doubles(MT.histogram_quantile(h, ["model_name", "model_version"], 0.95))


@query("error_rate", "with " + M.PREDICTIONS_SQL + """
select model_name, time_bucket(interval 1 hour, "timestamp") window_start,
       time_bucket(interval 1 hour, "timestamp") + interval 1 hour window_end,
       count(*) n, count(*) filter (where status = 'error') errors,
       round(100.0 * count(*) filter (where status = 'error') / count(*), 6) error_rate
from predictions group by all
""")
def error_rate(spark, sf):
    return round_doubles(MT.error_rate(M.predictions(spark, sf), ["model_name"], "timestamp", "1 hour"))


@query("prediction_rate", "with " + M.PREDICTIONS_SQL + """
select model_name, time_bucket(interval 1 minute, "timestamp") window_start, count(*) n,
       round(count(*) / 60.0, 6) rate
from predictions group by all
""")
def prediction_rate(spark, sf):
    return round_doubles(MT.prediction_rate(M.predictions(spark, sf), ["model_name"], "timestamp"))


@query("platform_totals", "with " + M.PREDICTIONS_SQL + """
select count(distinct model_name) active_models, count(*) total_predictions from predictions
""")
def platform_totals(spark, sf):
    return MT.platform_totals(M.predictions(spark, sf))


@query("dashboard_summary", "with " + M.PREDICTIONS_SQL + "," + M.DRIFT_REPORTS_SQL + """,
p as (select model_name, count(*) total_predictions, avg(latency_ms) avg_latency_ms from predictions
      where "timestamp" between timestamp '2024-01-30 00:00:00' - interval 7 day and timestamp '2024-01-30 00:00:00'
      group by model_name),
r as (select model_name, count(*) filter (where drift_detected) drift_detections from drift_reports
      where created_at between timestamp '2024-01-30 00:00:00' - interval 7 day and timestamp '2024-01-30 00:00:00'
      group by model_name)
select coalesce(p.model_name, r.model_name) model_name, coalesce(total_predictions, 0) total_predictions,
       coalesce(drift_detections, 0) drift_detections, round(avg_latency_ms, 6) avg_latency_ms
from p full join r on p.model_name = r.model_name
""")
def dashboard_summary(spark, sf):
    out = MT.dashboard_summary(M.predictions(spark, sf), M.drift_reports(spark, sf), "2024-01-30 00:00:00", 7)
    return round_doubles(out)


@query("training_duration", "with " + M.TRAINING_RUNS_SQL + """,
b as (select unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
                     'inf'::double]) le)
select model_type, le, count(*) filter (where epoch(completed_at) - epoch(started_at) <= le) count
from training_runs, b where completed_at is not null group by all
""")
def training_duration(spark, sf):
    return MT.training_duration_histogram(M.training_runs(spark, sf))


@query("recent_vs_older", "with " + M.PREDICTIONS_SQL + """,
r as (select model_name, cast(actual = prediction as double) c,
             row_number() over (partition by model_name order by "timestamp", prediction_id) ra,
             count(*) over (partition by model_name) n
      from predictions),
a as (select model_name, n, avg(c) accuracy, avg(c) filter (where ra <= 1000) older_accuracy,
             avg(c) filter (where n - ra < 1000) recent_accuracy from r group by model_name, n)
select model_name, n total_predictions, round(accuracy, 6) accuracy, round(older_accuracy, 6) older_accuracy,
       round(recent_accuracy, 6) recent_accuracy, round(older_accuracy - recent_accuracy, 6) accuracy_drop,
       older_accuracy - recent_accuracy > 0.05 degraded
from a where n >= 1000
""")
def recent_vs_older(spark, sf):
    p = M.predictions(spark, sf)
    out = MT.recent_vs_older(p, ["model_name"], ["timestamp", "prediction_id"],
                             F.col("actual") == F.col("prediction"), 1000)
    return round_doubles(out)


@query("rolling_accuracy", "with " + M.PREDICTIONS_SQL + """
select prediction_id, model_name,
       round(avg(cast(actual = prediction as double)) over (partition by model_name order by "timestamp", prediction_id
             rows between 99 preceding and current row), 6) rolling_accuracy
from predictions
""")
def rolling_accuracy(spark, sf):
    p = M.predictions(spark, sf).select("prediction_id", "model_name", "timestamp", "actual", "prediction")
    out = MT.rolling_accuracy(p, ["model_name"], ["timestamp", "prediction_id"],
                              F.col("actual") == F.col("prediction"), 100)
    return out.select("prediction_id", "model_name", r6("rolling_accuracy").alias("rolling_accuracy"))


@query("gauge_last", "with " + M.DRIFT_REPORTS_SQL + """
select model_name, feature_name, drift_type, drift_score from (
  select *, row_number() over (partition by model_name, feature_name, drift_type
                               order by created_at desc, report_seq desc) rn from drift_reports) where rn = 1
""")
def gauge_last(spark, sf):
    r = M.drift_reports(spark, sf)
    return MT.gauge_last(r, ["model_name", "feature_name", "drift_type"], "drift_score", ["created_at", "report_seq"])


@query("join_ground_truth", """
select d.doc_id prediction_id, cast(n_chars > 2000 as int) prediction, l.quality actual
from documents d left join labels l on l.doc_id = d.doc_id
""")
def join_ground_truth(spark, sf):
    preds = M.scored_documents(spark, sf).select("prediction_id", "prediction")
    return MT.join_ground_truth(preds, M.ground_truth(spark, sf))
