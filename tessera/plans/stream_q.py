"""Streaming queries (ST1–ST9): ``events`` replayed through Structured Streaming.

Each query runs ``availableNow`` into a Parquet sink in the shared folder and
returns that table.  Append mode emits a window only once it is closed by the
watermark (max event time − delay), so the oracles keep exactly the windows
whose end is at or below it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import mappings as M
from tessera.plans.common import query, r6, round_doubles, tbl
from tessera.streaming import io as SIO
from tessera.streaming import monitors as MON


def _pred_stream(spark, sf):
    s = SIO.read_table_stream(spark, sf, "events.parquet")
    p = M.predictions_from_events(s)
    return p.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _wm(delay: str) -> str:
    """DuckDB text of the final watermark: max event time (ms) minus the delay."""
    return f"(select date_trunc('millisecond', max(ts)) - interval {delay} from events)"


@query("stream_prediction_counts", "with " + M.PREDICTIONS_SQL + f"""
select * from (
  select time_bucket(interval 1 minute, "timestamp") window_start,
         time_bucket(interval 1 minute, "timestamp") + interval 1 minute window_end,
         model_name, model_version, status, count(*) n
  from predictions group by all)
where window_end <= {_wm("10 minutes")}
""")
def stream_prediction_counts(spark, sf):
    return SIO.run_available_now(MON.prediction_counts(_pred_stream(spark, sf)), "prediction-counts")


@query("stream_error_rate", "with " + M.PREDICTIONS_SQL + f""",
w as (select 1)
select * from (
  select window_start, window_start + interval 5 minute window_end, model_name, count(*) n,
         count(*) filter (where status = 'error') errors,
         round(count(*) filter (where status = 'error') * 100.0 / count(*), 6) error_rate
  from (select p.*, time_bucket(interval 1 minute, p."timestamp") - to_minutes(s) window_start
        from predictions p, range(0, 5) t(s))
  group by window_start, model_name)
where window_end <= {_wm("10 minutes")}
""")
def stream_error_rate(spark, sf):
    out = SIO.run_available_now(MON.error_rate(_pred_stream(spark, sf)), "error-rate")
    return round_doubles(out)


@query("stream_latency_histogram", "with " + M.PREDICTIONS_SQL + f"""
select * from (
  select time_bucket(interval 5 minute, "timestamp") window_start,
         time_bucket(interval 5 minute, "timestamp") + interval 5 minute window_end, model_name,
         {", ".join(f"count(*) filter (where latency_ms / 1000.0 <= {b}) le_{i}" for i, b in
                    enumerate((0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)))},
         count(*) le_inf
  from predictions group by all)
where window_end <= {_wm("10 minutes")}
""")
def stream_latency_histogram(spark, sf):
    return SIO.run_available_now(MON.latency_histogram(_pred_stream(spark, sf)), "latency-histogram")


@query("stream_cache_dedup", f"""
with recursive p as (
  select md5('{{"k":"' || (props->>'k') || '"}}') features_hash, date_trunc('millisecond', ts) t from events),
stored as (
  select features_hash, min(t) t from p group by features_hash
  union all
  select s.features_hash, min(p.t) t from stored s join p on p.features_hash = s.features_hash
    and p.t >= s.t + interval 300 second group by s.features_hash, s.t)
select r.features_hash, r.n_requests, f.n_fresh
from (select features_hash, count(*) n_requests from p where t < {_wm("10 minutes")} group by 1) r
join (select features_hash, count(*) n_fresh from stored where t < {_wm("10 minutes")} group by 1) f
  on r.features_hash = f.features_hash
""")
def stream_cache_dedup(spark, sf):
    """Requests per feature document, and those that a 300 s cache doesn't answer."""
    from tessera.functions.transforms import features_hash
    s = _pred_stream(spark, sf).withColumn("features_hash", features_hash(F.col("features")))
    out = SIO.run_available_now(MON.prediction_cache(s, "features_hash"), "cache")
    return out.groupBy(F.col("cache_key").alias("features_hash")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if(~F.col("cached")).alias("n_fresh"))


GT_DELAY = "1 hour"


def _actuals(stream):
    return stream.where(F.col("status") != "error").select(
        F.col("prediction_id").alias("actual_id"), F.col("actual"),
        (F.col("timestamp") + F.expr("INTERVAL 30 MINUTES")).alias("actual_ts"))


@query("stream_ground_truth_join", "with " + M.PREDICTIONS_SQL + f""",
a as (select prediction_id actual_id, actual, "timestamp" + interval 30 minute actual_ts from predictions
      where status <> 'error'),
j as (select p.prediction_id, p.model_name, p.prediction, p."timestamp", a.actual, a.actual_ts
      from predictions p left join a on a.actual_id = p.prediction_id
       and a.actual_ts >= p."timestamp" and a.actual_ts <= p."timestamp" + interval 1 hour)
select * from j where actual_ts is not null or "timestamp" + interval 1 hour < {_wm("1 hour")}
""")
def stream_ground_truth_join(spark, sf):
    """Predictions with actuals arriving 30 minutes later (errors never get one): every
    match, and the unmatched predictions that the watermark has passed."""
    p = _pred_stream(spark, sf)
    return SIO.run_available_now(MON.ground_truth_join(p, _actuals(_pred_stream(spark, sf)), GT_DELAY), "ground-truth")


@query("stream_rolling_accuracy", "with " + M.PREDICTIONS_SQL + """
select model_name, count(*) buffered, avg(cast(actual = prediction as int)) rolling_accuracy, max("timestamp") last_ts
from (select *, row_number() over (partition by model_name order by "timestamp" desc, prediction_id desc) rn
      from predictions) where rn <= 10000 group by model_name
""")
def stream_rolling_accuracy(spark, sf):
    """Rolling accuracy over each model's newest 10000 predictions: the last snapshot per model,
    the same for any division into micro-batches."""
    from tessera.operators.catalog import latest_per_key
    s = _pred_stream(spark, sf)
    out = SIO.run_available_now(MON.rolling_accuracy(s), "rolling-accuracy")
    out = latest_per_key(out, ["model_name"], ["last_ts", "buffered"])
    return out.withColumn("rolling_accuracy", r6("rolling_accuracy"))


@query("stream_log_sink", "with " + M.PREDICTIONS_SQL + """
select model_name, count(*) n, count(distinct prediction_id) ids from predictions group by model_name
""")
def stream_log_sink(spark, sf):
    """Prediction log appended per micro-batch (idempotent by batch id), read back."""
    from tessera.session import scratch_path
    s = _pred_stream(spark, sf).withColumn("log_date", F.to_date("timestamp"))
    back = SIO.foreach_batch_append(s.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")),
                                    scratch_path(spark, "stream-log"), "stream-log")
    return back.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"),
                                          F.count_distinct("prediction_id").alias("ids"))


@query("stream_alerts", "with " + M.PREDICTIONS_SQL + """,
ev as (select model_name, epoch_us("timestamp") // 60000000 m, status from predictions),
first_minute as (select model_name, min(m) m0 from ev group by model_name),
fin as (select (epoch_us(date_trunc('millisecond', max(ts))) // 1000 - 120000) // 60000 - 1 f from events),
grid as (select first_minute.model_name, unnest(range(m0, f + 1)) m from first_minute, fin),
cnt as (select model_name, m, count(*) n, count(*) filter (where status = 'error') e from ev group by all),
g as (select grid.model_name, grid.m, coalesce(cnt.n, 0) n, coalesce(cnt.e, 0) e
      from grid left join cnt on cnt.model_name = grid.model_name and cnt.m = grid.m),
w as (select model_name, m, sum(n) over win sn, sum(e) over win se from g
      window win as (partition by model_name order by m rows between 4 preceding and current row)),
b as (select *, sn > 0 and 100.0::double * se / sn > 5.0 br from w),
isl as (select *, m - row_number() over (partition by model_name, br order by m) grp from b),
runs as (select *, row_number() over (partition by model_name, grp order by m) k,
                min(m) over (partition by model_name, grp) s from isl where br)
select model_name, make_timestamp(s * 60000000) alert_start, make_timestamp(m * 60000000) alert_minute,
       cast(k as bigint) minutes_held, round(100.0::double * se / sn, 6) error_rate
from runs where k = 5
""")
def stream_alerts(spark, sf):
    """Models whose error share over the trailing 5 minutes, evaluated every minute,
    stayed above 5 % for 5 consecutive evaluations."""
    s = _pred_stream(spark, sf)
    out = SIO.run_available_now(MON.held_alerts(s, 5.0, 5), "alerts")
    return out.withColumn("error_rate", r6("error_rate"))


REF_SPLIT = "2024-01-15 00:00:00"


@query("stream_drift", "with " + M.PREDICTIONS_SQL + f""",
ref as (select latency_ms v from predictions where "timestamp" < timestamp '{REF_SPLIT}'),
e as (select list_sort(list_distinct(list_transform(
        quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda t: round(t, 9)))) edges
      from ref),
bins as (select unnest(range(0, (select len(edges) - 1 from e))) b),
rs as (select b, (select count(*) from ref, e where len(list_filter(edges[2:len(edges)-1], lambda x: v > x)) = b)
                 / (select count(*) from ref)::double share from bins),
cur as (select time_bucket(interval 1 hour, "timestamp") window_start, len(list_filter(edges[2:len(edges)-1],
               lambda x: latency_ms > x)) b from predictions, e),
cnt as (select window_start, count(*) n from cur group by window_start),
wb as (select c.window_start, c.n, bins.b, (select count(*) from cur x where x.window_start = c.window_start
                                            and x.b = bins.b) k from cnt c, bins)
select window_start, window_start + interval 1 hour window_end, n,
       round(sum((greatest(k / n, 0.0001) - greatest(share, 0.0001))
                 * ln(greatest(k / n, 0.0001) / greatest(share, 0.0001))), 6) psi
from wb join rs using (b)
where window_start + interval 1 hour <= {_wm("10 minutes")}
group by window_start, n
""")
def stream_drift(spark, sf):
    """Hourly PSI of latency against reference bins fitted on the first half of the log."""
    from tessera.operators.features import quantile_edges
    p = M.predictions(spark, sf)
    ref = p.where(F.col("timestamp") < F.lit(REF_SPLIT).cast("timestamp_ntz"))
    edges = quantile_edges(ref, "latency_ms", 10).first()["edges"]
    inner = edges[1:-1]
    code = sum([F.when(F.col("latency_ms") > F.lit(float(e)), 1).otherwise(0) for e in inner], F.lit(0))
    shares_rows = ref.groupBy(code.alias("b")).count().collect()
    total = sum(r["count"] for r in shares_rows)
    shares = [0.0] * (len(inner) + 1)
    for r in shares_rows:
        shares[r["b"]] = r["count"] / total
    s = _pred_stream(spark, sf)
    out = SIO.run_available_now(MON.windowed_psi(s, "latency_ms", edges, shares), "drift")
    return out.withColumn("psi", r6("psi"))
