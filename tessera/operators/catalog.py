"""Catalog tables: versions, stages, runs, feature sets, online features, reports.

Parquet tables are immutable, so every change is an appended event row (an
update, a stage transition, a tombstone) and the current state is a "latest row
per key" view.  Latest-per-key is ``max_by`` over a struct: a declarative
aggregate with a map-side partial step, so a key holding a third of all rows
still sends one row per task to the shuffle -- no sort of the whole group.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order_struct(order: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The newest row of each key by ``order`` (lexicographic, all descending).

    ``max_by(struct(row), struct(order))``: partial aggregation per task, then one
    row per key; ties in ``order`` should be broken by including a unique column.
    """
    cols = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.max_by(row, _order_struct(order)).alias("__r"))
            .select(*keys, *[F.col(f"__r.{c}").alias(c) for c in cols]))


def count_per_key(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Attach the row count of each key (aggregate + join, not a window over the group)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, list(keys), "left")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """``orderBy(...).limit(n)``: TakeOrderedAndProject, a per-task top-n then a merge."""
    return df.orderBy(*order).limit(n)


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank_col: str = "rank") -> DataFrame:
    """n first rows per key: ``row_number() <= n`` (Spark inserts a partial group limit
    before the shuffle, so each task forwards at most n rows per key)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


# ---------------------------------------------------------------- filters

def filter_dynamic(df: DataFrame, filters: Mapping[str, object], order: Sequence[Column],
                   limit: int | None = None) -> DataFrame:
    """Optional equality filters ANDed (None = no filter), ordered, limited."""
    preds = [F.col(k) == F.lit(v) for k, v in filters.items() if v is not None]
    out = df.where(reduce(lambda a, b: a & b, preds)) if preds else df
    out = out.orderBy(*order)
    return out.limit(limit) if limit is not None else out


def filter_name_stage(df: DataFrame, name_filter: str | None, stage: str | None, order: Sequence[Column],
                      limit: int | None = None, name_col: str = "model_name", stage_col: str = "model_stage") -> DataFrame:
    """Case-insensitive substring on the name, equality on stage; ordered before the limit."""
    out = df
    if name_filter:
        out = out.where(F.lower(F.col(name_col)).contains(name_filter.lower()))
    if stage:
        out = out.where(F.col(stage_col) == stage)
    out = out.orderBy(*order)
    return out.limit(limit) if limit is not None else out


def filter_time_range(df: DataFrame, ts_col: str, as_of, days: int) -> DataFrame:
    """Rows in the last ``days`` days up to ``as_of`` (inclusive); pushes down to Parquet."""
    if not 1 <= days <= 30:
        raise ValueError("days must be within 1..30")
    end = F.lit(as_of).cast("timestamp_ntz")
    start = end - F.make_dt_interval(F.lit(days))
    return df.where((F.col(ts_col) >= start) & (F.col(ts_col) <= end))


def lookup_keys(df: DataFrame, key_col: str, keys: Iterable, key_type: str | None = None) -> DataFrame:
    """All rows of the given keys (absent keys → no rows).

    A semi join without a hint: it is a broadcast join where the list is measured to
    be small, and a shuffle join otherwise.
    """
    spark = df.sparkSession
    keys = list(keys)
    dt = key_type or df.schema[key_col].dataType.simpleString()
    ids = spark.createDataFrame([(k,) for k in keys], f"__key {dt}")
    return df.join(ids, df[key_col] == ids["__key"], "left_semi")


def prediction_log_scan(df: DataFrame, model_name: str | None = None, start=None, end=None,
                        limit: int | None = None, ts_col: str = "timestamp", id_col: str = "prediction_id") -> DataFrame:
    """Filter by model and inclusive time range, newest first; all rows unless ``limit`` is given."""
    out = df
    if model_name is not None:
        out = out.where(F.col("model_name") == model_name)
    if start is not None:
        out = out.where(F.col(ts_col) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col(ts_col) <= F.lit(end).cast("timestamp_ntz"))
    out = out.orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
    return out.limit(limit) if limit is not None else out


# ---------------------------------------------------------------- stages

# The stages and their order.
STAGE_RANK = {"None": 0, "Staging": 1, "Production": 2, "Archived": 3}


def stage_events_from_versions(versions: DataFrame) -> DataFrame:
    """Expand versions into stage events: registered → Staging → target stage.

    Each version is registered (stage None) at ``created_at``, moves to Staging one
    hour later and to its recorded stage (if beyond Staging) one day later.
    """
    created = F.col("created_at")
    ev = F.array(
        F.struct(F.lit("None").alias("stage"), created.alias("event_time"), F.lit("registered").alias("comment")),
        F.struct(F.lit("Staging").alias("stage"), (created + F.expr("INTERVAL 1 HOUR")).alias("event_time"),
                 F.lit("validation").alias("comment")),
        F.struct(F.col("model_stage").alias("stage"), (created + F.expr("INTERVAL 1 DAY")).alias("event_time"),
                 F.concat(F.lit("to "), F.col("model_stage")).alias("comment")),
    )
    return (versions.select("model_name", "model_version", F.explode(ev).alias("e"))
            .where(~((F.col("e.stage").isin("None", "Staging")) & (F.col("e.comment").startswith("to "))))
            .select("model_name", "model_version", "e.stage", "e.event_time", "e.comment"))


def stage_history(events: DataFrame) -> DataFrame:
    """Transitions with the previous stage (``lag`` within one version's events)."""
    w = Window.partitionBy("model_name", "model_version").orderBy("event_time")
    return events.withColumn("from_stage", F.coalesce(F.lag("stage").over(w), F.lit("None"))).withColumnRenamed(
        "stage", "to_stage")


def current_stage(events: DataFrame) -> DataFrame:
    """Stage of each version now: its newest event."""
    return latest_per_key(events, ["model_name", "model_version"], ["event_time"]).select(
        "model_name", "model_version", F.col("stage").alias("current_stage"), F.col("event_time").alias("since"))


def production_version(current: DataFrame, all_models: DataFrame | None = None) -> DataFrame:
    """Version per model that went to Production last; models without one get NULL."""
    prod = _newest_in(current, "Production")
    if all_models is None:
        return prod
    return all_models.select("model_name").distinct().join(prod, "model_name", "left")


def _newest_in(current: DataFrame, stage: str) -> DataFrame:
    newest = F.max_by("model_version", F.struct("since", "model_version"))
    return (current.where(F.col("current_stage") == stage)
            .groupBy("model_name").agg(newest.alias(f"{stage.lower()}_version")))


def serving_version(current: DataFrame) -> DataFrame:
    """The version to serve per model: the newest in Production, else the newest in stage None;
    models with neither get NULL."""
    j = (current.select("model_name").distinct().join(_newest_in(current, "Production"), "model_name", "left")
         .join(_newest_in(current, "None"), "model_name", "left"))
    return j.select("model_name", F.coalesce("production_version", "none_version").alias("serving_version"),
                    F.when(F.col("production_version").isNotNull(), "Production")
                    .when(F.col("none_version").isNotNull(), "None").alias("stage"))


def transition_stage(events: DataFrame, model_name: str, model_version, stage: str, comment: str,
                     at) -> DataFrame:
    """The new event row for a transition (append it; current state follows by W1)."""
    if stage not in STAGE_RANK:
        raise ValueError(f"unknown stage {stage}")
    spark = events.sparkSession
    return spark.createDataFrame([(model_name, model_version, stage, at, comment)],
                                 events.schema)


# ---------------------------------------------------------------- joins

def online_features(feature_rows: DataFrame, entity_col: str, order: Sequence[str],
                    entity_ids: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Latest feature row per entity, restricted to the requested ids.

    ``entity_ids`` is a DataFrame (any size): a semi join keeps the entities it
    names, and the newest row per entity is an aggregate, not a sort.
    """
    ids = entity_ids.select(F.col(entity_ids.columns[0]).alias(entity_col)).distinct()
    latest = latest_per_key(feature_rows.join(ids, entity_col, "left_semi"), [entity_col], order)
    if names:
        latest = latest.select(entity_col, *names)
    return latest


def version_metrics(versions: DataFrame, runs: DataFrame, metric: str, models: Sequence[str] | None = None
                    ) -> DataFrame:
    """Versions with their run's metric (missing → 0): left join on run_id."""
    v = versions
    if models:
        v = v.where(F.col("model_name").isin(list(models)))
    r = runs.select("run_id", F.col(metric).alias("__m"))
    return (v.join(r, "run_id", "left")
            .withColumn(metric, F.coalesce(F.col("__m"), F.lit(0.0))).drop("__m"))


# ---------------------------------------------------------------- S13/S14 metadata events

def metadata_events(changes: DataFrame, key_cols: Sequence[str], ts_col: str, deleted_col: str = "deleted"
                    ) -> DataFrame:
    """Current state of a keyed table kept as append-only change rows.

    The newest change per key wins; a tombstone (``deleted``) hides the key.
    """
    latest = latest_per_key(changes, list(key_cols), [ts_col])
    return latest.where(~F.coalesce(F.col(deleted_col), F.lit(False))).drop(deleted_col)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Append to a Parquet table (idempotence is the caller's: see foreachBatch sinks)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
