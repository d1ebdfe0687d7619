"""Monitoring metrics over prediction logs and evaluation tables.

Classification metrics are computed from the confusion counts (one aggregate of
k² rows), so they work on a log of any size.  Rank-based windows -- newest/oldest
w rows, rolling accuracy over the last k rows -- use the distributed prefix sums
of ``ranks`` rather than a per-model sort in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import latest_per_key
from tessera.operators.ranks import _attach, exact_quantiles, prefix_sums

# Histogram bucket upper bounds (seconds).
LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
LOG_LOSS_EPS = 1e-15
MAX_LABELS = 1000  # confusion matrices are k x k: the label list is checked before use


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- classification

def _labels(df: DataFrame, actual: str, predicted: str) -> list:
    vals = (df.select(F.col(actual).alias("l")).union(df.select(F.col(predicted).alias("l")))
            .where(F.col("l").isNotNull()).distinct().limit(MAX_LABELS + 1).collect())
    if len(vals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return sorted(r[0] for r in vals)


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence | None = None) -> DataFrame:
    """Long form ``(actual, predicted, n)`` over sorted labels, zeros filled.

    One pivoted aggregate (pre-combined per task); the label grid is completed
    by joining onto the label list, never by pairing data rows.
    """
    labels = list(labels) if labels is not None else _labels(df, actual, predicted)
    spark = df.sparkSession
    counts = df.groupBy(F.col(actual).alias("actual")).pivot(predicted, labels).count()
    dt = df.schema[actual].dataType.simpleString()
    grid = spark.createDataFrame([(lab,) for lab in labels], f"actual {dt}")
    wide = grid.join(counts, "actual", "left")
    pairs = F.array(*[F.struct(F.lit(lab).alias("predicted"),
                               F.coalesce(F.col(f"`{lab}`"), F.lit(0)).cast("bigint").alias("n"))
                      for lab in labels])
    return wide.select("actual", F.inline(pairs))


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The cells of the confusion matrix that are not 0, for any number of labels:
    ``(actual, predicted, n, recall_share, precision_share)``, n as a share of its row and of
    its column.  One aggregate over the rows, then joins of its result; rows with a NULL on
    either side are no cell of the matrix.
    """
    cells = (df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
             .where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
             .groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n")))
    of_row = cells.groupBy("actual").agg(F.sum("n").alias("row_n"))
    of_column = cells.groupBy("predicted").agg(F.sum("n").alias("column_n"))
    return cells.join(of_row, "actual").join(of_column, "predicted").select(
        "actual", "predicted", "n", (F.col("n") / F.col("row_n")).alias("recall_share"), (F.col("n") / F.col("column_n")).alias("precision_share"))


def per_class_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(cls, support, predicted_n, tp)`` from one (actual, predicted) aggregate."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    as_actual = pairs.select(F.col("a").alias("cls"), F.col("n").alias("support"), F.lit(0).alias("predicted_n"),
                             F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"))
    as_pred = pairs.select(F.col("p").alias("cls"), F.lit(0).alias("support"), F.col("n").alias("predicted_n"),
                           F.lit(0).alias("tp"))
    return (as_actual.unionByName(as_pred).groupBy("cls")
            .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("support", "predicted_n", "tp")]))


def classification_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy; precision, recall, F1 weighted by true-class support (0 on zero division); count."""
    keys = list(keys)
    pairs = df.groupBy(*keys, F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    as_actual = pairs.select(*keys, F.col("a").alias("cls"), F.col("n").alias("support"),
                             F.lit(0).cast("bigint").alias("predicted_n"),
                             F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"))
    as_pred = pairs.select(*keys, F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                           F.col("n").alias("predicted_n"), F.lit(0).cast("bigint").alias("tp"))
    per = (as_actual.unionByName(as_pred).groupBy(*keys, "cls")
           .agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "predicted_n", "tp")]))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    per = per.select(*keys, "support", "tp", prec.alias("prec"), rec.alias("rec"), f1.alias("f1"))
    n = F.sum("support")
    agg = per.groupBy(*keys).agg(
        F.try_divide(F.sum("tp"), n).alias("accuracy"),
        F.try_divide(F.sum(F.col("prec") * F.col("support")), n).alias("precision"),
        F.try_divide(F.sum(F.col("rec") * F.col("support")), n).alias("recall"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), n).alias("f1_score"),
        n.cast("bigint").alias("prediction_count"),
    )
    return agg


def roc_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Binary ROC AUC, exact, ties share credit (Mann–Whitney U / (P·N)).

    Rows are first reduced to (keys, score) → positives/negatives; the number of
    negatives scoring below each score is a distributed prefix sum.
    """
    keys = list(keys) or ["__all"]
    base = df if "__all" not in keys else df.withColumn("__all", F.lit(0))
    by_score = (base.where(F.col(score).isNotNull() & F.col(label).isNotNull())
                .groupBy(*keys, F.col(score).cast("double").alias("s"))
                .agg(F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("pos"),
                     F.sum(F.when(F.col(label) == 1, 0.0).otherwise(1.0)).alias("neg")))
    cum = prefix_sums(by_score, keys, "s", ["neg"]).drop("total_neg")
    u = cum.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    out = u.select(*keys, F.try_divide(F.col("u"), F.col("p") * F.col("q")).alias("roc_auc"),
                   F.col("p").cast("bigint").alias("positives"), F.col("q").cast("bigint").alias("negatives"))
    return out.drop("__all")


def log_loss(df: DataFrame, label: str, prob: str, keys: Sequence[str] = (), eps: float = LOG_LOSS_EPS
             ) -> DataFrame:
    """Binary log loss: mean of −ln p(true class), p clipped to [eps, 1 − eps]."""
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(eps)), F.lit(1 - eps))
    ll = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    return df.groupBy(*keys).agg(F.avg(ll).alias("log_loss"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- latency and counts

def latency_summary(df: DataFrame, keys: Sequence[str], ts: str, latency: str, approx: bool = False
                    ) -> DataFrame:
    """Count, time span, mean, p95, p99 (linear interpolation) per key."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_predictions"), F.min(ts).alias("start"),
                                 F.max(ts).alias("end"), F.avg(latency).alias("mean_ms"))
    if approx:
        q = df.groupBy(*keys).agg(F.percentile_approx(latency, [0.95, 0.99], 10_000).alias("quantiles"))
    else:
        q = exact_quantiles(df, keys, latency, [0.95, 0.99])
    # null-safe: a NULL key is a key of its own
    return _attach(base, q, keys).select(
        *keys, "total_predictions", "start", "end", "mean_ms",
        F.col("quantiles")[0].alias("p95_ms"), F.col("quantiles")[1].alias("p99_ms"))


def prediction_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("model_name", "model_version", "status").agg(F.count(F.lit(1)).alias("count"))


def cumulative_histogram(df: DataFrame, keys: Sequence[str], value: Column, buckets: Sequence[float]
                         ) -> DataFrame:
    """Cumulative ``le`` buckets (+Inf last) per key: one aggregate, then unpivot."""
    items = [F.struct(F.lit(float(b)).alias("le"), F.count_if(value <= F.lit(float(b))).alias("count"))
             for b in buckets]
    items.append(F.struct(F.lit(float("inf")).alias("le"), F.count(F.lit(1)).alias("count")))
    return df.groupBy(*keys).agg(F.array(*items).alias("h")).select(*keys, F.inline("h"))


def latency_histogram(df: DataFrame, keys: Sequence[str] = ("model_name", "model_version"),
                      latency_ms: str = "latency_ms") -> DataFrame:
    return cumulative_histogram(df, keys, F.col(latency_ms) / 1000.0, LATENCY_BUCKETS)


def histogram_quantile(hist: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket (PromQL semantics).

    A bucket table has a dozen rows per key, so this works on one small row
    per key: the buckets are gathered into a sorted array and scanned with
    ``aggregate``.  Rank in the +Inf bucket → the highest finite bound.
    """
    keys = list(keys)
    arr = hist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", "count"))).alias("b"))
    total = F.element_at("b", -1)["count"].cast("double")
    rank = F.lit(q) * total
    # first bucket whose cumulative count reaches the rank
    idx = F.array_position(F.transform("b", lambda s: s["count"] >= rank), True)
    cur = F.element_at("b", idx.cast("int"))
    prev = F.when(idx > 1, F.element_at("b", (idx - 1).cast("int")))
    lo = F.coalesce(prev["le"], F.lit(0.0))
    prev_n = F.coalesce(prev["count"], F.lit(0)).cast("double")
    finite_max = F.element_at("b", -2)["le"]
    val = F.when(total == 0, F.lit(None)).when(F.isnull(idx) | (idx == 0), F.lit(None)).when(
        cur["le"] == float("inf"), finite_max).otherwise(
        lo + (cur["le"] - lo) * F.coalesce(F.try_divide(rank - prev_n, cur["count"] - prev_n), F.lit(0.0)))
    return arr.select(*keys, val.alias("quantile"))


def error_rate(df: DataFrame, keys: Sequence[str], ts: str, window: str = "5 minutes",
               slide: str | None = None) -> DataFrame:
    """Errors / all × 100 per event-time window."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return df.groupBy(*keys, w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors")).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "errors",
        (F.try_divide(F.col("errors"), F.col("n")) * 100).alias("error_rate"))


def prediction_rate(df: DataFrame, keys: Sequence[str], ts: str, window: str = "1 minute",
                    seconds: int = 60) -> DataFrame:
    """Predictions per second per window."""
    return df.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("w.start").alias("window_start"), "n", (F.col("n") / float(seconds)).alias("rate"))


def platform_totals(df: DataFrame) -> DataFrame:
    """active_models (distinct) and total_predictions."""
    return df.agg(F.count_distinct("model_name").alias("active_models"),
                  F.count(F.lit(1)).alias("total_predictions"))


def dashboard_summary(preds: DataFrame, reports: DataFrame, as_of, days: int) -> DataFrame:
    """Per model over the last ``days`` days: predictions, drift detections, mean latency."""
    end = F.lit(as_of).cast("timestamp_ntz")
    start = end - F.make_dt_interval(F.lit(days))
    p = (preds.where((F.col("timestamp") >= start) & (F.col("timestamp") <= end))
         .groupBy("model_name").agg(F.count(F.lit(1)).alias("total_predictions"),
                                    F.avg("latency_ms").alias("avg_latency_ms")))
    r = (reports.where((F.col("created_at") >= start) & (F.col("created_at") <= end))
         .groupBy("model_name").agg(F.count_if("drift_detected").alias("drift_detections")))
    return p.join(r, "model_name", "full").select(
        "model_name", F.coalesce("total_predictions", F.lit(0)).alias("total_predictions"),
        F.coalesce("drift_detections", F.lit(0)).alias("drift_detections"), "avg_latency_ms")


def dataset_summary(df: DataFrame, target: str, numeric: Sequence[str]) -> DataFrame:
    """Rows, columns, target rate and averages."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.avg(F.col(target).cast("double")).alias("target_rate"),
                  *[F.avg(c).alias(f"avg_{c}") for c in numeric])


def training_duration_histogram(runs: DataFrame) -> DataFrame:
    dur = F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(
        F.col("started_at").cast("timestamp"))
    return cumulative_histogram(runs.where(F.col("completed_at").isNotNull()), ["model_type"],
                                dur.cast("double"), DEFAULT_BUCKETS)


# ---------------------------------------------------------------- rank windows

def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (1-based position within keys by order) and ``cum_<v>`` sums."""
    base = df.withColumn("__one", F.lit(1.0))
    out = prefix_sums(base, keys, order, ["__one", *values])
    return (out.withColumn("rank", F.col("cum___one").cast("bigint"))
            .withColumn("n_rows", F.col("total___one").cast("bigint"))
            .drop("__one", "cum___one", "total___one", *[f"total_{v}" for v in values]))


def recent_vs_older(df: DataFrame, keys: Sequence[str], order: Sequence[str], correct: Column, window: int,
                    threshold: float = 0.05) -> DataFrame:
    """Accuracy of the oldest and newest ``window`` rows per key; degraded when the drop
    exceeds ``threshold``.  Only keys with at least ``window`` rows are reported."""
    keys = list(keys)
    r = _ranked(df.withColumn("__c", correct.cast("double")), keys, order, []).withColumnRenamed("n_rows", "n")
    older = F.avg(F.when(F.col("rank") <= window, F.col("__c")))
    recent = F.avg(F.when(F.col("n") - F.col("rank") < window, F.col("__c")))
    agg = r.groupBy(*keys, "n").agg(F.avg("__c").alias("accuracy"), older.alias("older_accuracy"),
                                     recent.alias("recent_accuracy"))
    agg = agg.where(F.col("n") >= window)
    drop = F.col("older_accuracy") - F.col("recent_accuracy")
    return agg.select(*keys, F.col("n").alias("total_predictions"), "accuracy", "older_accuracy",
                      "recent_accuracy", drop.alias("accuracy_drop"), (drop > threshold).alias("degraded"))


def rolling_accuracy(df: DataFrame, keys: Sequence[str], order: Sequence[str], correct: Column, k: int
                     ) -> DataFrame:
    """Accuracy over the last ``k`` rows (the row itself included) for every row.

    rolling(i) = (cum(i) − cum(i−k)) / min(i, k): ranks and running sums come from
    the distributed prefix sum, and cum(i−k) is an equi-join on (keys, rank − k),
    so no task ever holds a whole key.
    """
    keys = list(keys)
    ranked = _ranked(df.withColumn("__c", correct.cast("double")), keys, order, ["__c"])
    back = ranked.select(*keys, (F.col("rank") + k).alias("rank"), F.col("cum___c").alias("__back"))
    j = _attach(ranked, back, [*keys, "rank"])
    acc = (F.col("cum___c") - F.coalesce(F.col("__back"), F.lit(0.0))) / F.least(F.col("rank"), F.lit(k))
    return j.withColumn("rolling_accuracy", acc).drop("__c", "cum___c", "__back", "n_rows")


def gauge_last(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last value per key (a gauge): ``max_by`` on the order, partial-aggregated."""
    return latest_per_key(df.select(*keys, value, *order), keys, order).select(*keys, value)


def join_ground_truth(preds: DataFrame, actuals: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """Predictions with later actuals by id; unmatched predictions kept (actual NULL)."""
    return preds.join(actuals, id_col, "left")
