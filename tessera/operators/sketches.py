"""Mergeable summaries: latency quantiles over windows (A13), and dataset profiles.

A summary is a row; rows of several windows, files or versions are merged by an aggregate over
the rows, without the data that they stand for.

* Quantiles: KLL sketches.  A quantile's rank is off by ``rank_error(k)`` of the values at most
  (99 % of the time), however many sketches were merged.
* Distinct counts: HyperLogLog sketches of 2**lg_k registers, with a relative standard error of
  about ``1.04 / sqrt(2**lg_k)``.
* Mean and deviation: count, mean and sum of squared distances, merged pairwise (Chan), which
  loses no digits where the mean is large.
* Count, nulls, minimum, maximum and the smallest distinct values are exact.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.profile import _as_number, col_, is_numeric

#: Size of quantile sketches (rank error about 0.35 %) and of distinct sketches (standard error 0.8 %).
KLL_K, HLL_LG_K, SAMPLES = 800, 14, 5


def rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a KLL sketch at 99 % confidence.  Fixed values: the library's fit of its error."""
    return 2.296 / k**0.9723


# ---------------------------------------------------------------- A13 latency over windows

def latency_sketches(df: DataFrame, keys: Sequence[str], ts: str, latency: str, window: str = "1 hour", k: int = KLL_K) -> DataFrame:
    """One row per key and tumbling window: (keys, window_start, n, timed, start, end, sum_ms, sketch).  Rows without a
    latency count in ``n`` only."""
    x = F.col(latency).cast("double")
    return df.groupBy(*keys, F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("timed"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.sum(x).alias("sum_ms"),
        F.kll_sketch_agg_double(x, k).alias("sketch")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "timed", "start", "end", "sum_ms", "sketch")


def merged_latency(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float] = (0.95, 0.99), k: int = KLL_K) -> DataFrame:
    """Summary per key over all windows given: total_predictions, start, end, mean_ms, one ``p<percent>_ms`` per
    probability, and ``rank_error``, the share of values that a quantile's rank may be off."""
    own = sketches.groupBy(*keys).agg(
        F.sum("n").alias("total_predictions"), F.sum("timed").alias("timed"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("sum_ms").alias("sum_ms"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"))
    quantile = [F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(f"p{p * 100:g}_ms") for p in probs]
    return own.select(*keys, "total_predictions", "start", "end", F.try_divide(F.col("sum_ms"), F.col("timed")).alias("mean_ms"), *quantile, F.lit(rank_error(k)).alias("rank_error"))


# ---------------------------------------------------------------- S6 / A1 profiles of dataset versions

PROFILE_COLUMNS = ("column_name", "dtype", "n", "null_count", "mean", "m2", "min", "max", "distinct_sketch", "quantile_sketch", "samples")


def _moments(x: Column) -> tuple[Column, Column]:
    """Mean and sum of squared distances from it."""
    return F.avg(x), F.var_pop(x) * F.count(x)


def profile(df: DataFrame, columns: Sequence[str] | None = None, n_samples: int = SAMPLES) -> DataFrame:
    """One row per column with the summaries (``PROFILE_COLUMNS``): one aggregate over the rows, and the smallest distinct
    values from one window with a partial limit."""
    from tessera.operators.profile import _distinct_values

    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in columns:
        numeric = is_numeric(types[c])
        x = _as_number(c, types[c]).cast("double")
        mean, m2 = _moments(x)
        none = F.lit(None)
        structs.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(types[c].simpleString()).alias("dtype"), F.count(F.lit(1)).alias("n"),
            F.count_if(col_(c).isNull()).alias("null_count"), (mean if numeric else none).cast("double").alias("mean"),
            (m2 if numeric else none).cast("double").alias("m2"), (F.min(x) if numeric else none).cast("double").alias("min"),
            (F.max(x) if numeric else none).cast("double").alias("max"), F.hll_sketch_agg(_hashable(c, types[c]), HLL_LG_K).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(x, KLL_K) if numeric else none).cast("binary").alias("quantile_sketch")))
    base = df.agg(F.array(*structs).alias("s")).select(F.inline("s"))
    smallest = _smallest(_distinct_values(df, columns), n_samples)
    return base.join(smallest, "column_name", "left").select(*PROFILE_COLUMNS)


def _hashable(c: str, dt: T.DataType) -> Column:
    return col_(c) if isinstance(dt, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else col_(c).cast("string")


def _smallest(values: DataFrame, k: int) -> DataFrame:
    """(column_name, samples): the k smallest of (column_name, num, value), distinct."""
    from pyspark.sql import Window

    w = Window.partitionBy("column_name").orderBy(F.col("num").asc_nulls_last(), F.col("value"))
    rows = values.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "num", "value"))), lambda s: F.struct(s["num"].alias("num"), s["value"].alias("value")))
    return rows.groupBy("column_name").agg(ordered.alias("samples"))


def merge_profiles(profiles: DataFrame, n_samples: int = SAMPLES) -> DataFrame:
    """The rows of several profiles as one profile, column by column.  A column that some lack is merged from the
    others; where types differ, the first by name is given.  A column takes one row per profile."""
    part = F.struct((F.col("n") - F.col("null_count")).cast("double").alias("n"), "mean", "m2")
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def chan(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        return F.when(b["n"] <= 0, a).otherwise(F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2")))

    # in the order of the profiles' numbers, so that the sum does not depend on arrival
    parts = F.filter(F.array_sort(F.collect_list(part)), lambda p: p["mean"].isNotNull())
    own = profiles.groupBy("column_name").agg(
        F.min("dtype").alias("dtype"), F.sum("n").alias("n"), F.sum("null_count").alias("null_count"), F.aggregate(parts, start, chan).alias("moments"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", KLL_K).alias("quantile_sketch"), F.count("quantile_sketch").alias("numeric"))
    values = profiles.select("column_name", F.inline("samples")).distinct()
    out = own.join(_smallest(values, n_samples), "column_name", "left")
    some = F.col("moments.n") > 0
    return out.select("column_name", "dtype", "n", "null_count", F.when(some, F.col("moments.mean")).alias("mean"), F.when(some, F.col("moments.m2")).alias("m2"),
                      "min", "max", "distinct_sketch", F.when(F.col("numeric") > 0, F.col("quantile_sketch")).alias("quantile_sketch"), "samples")


def describe_profile(profiles: DataFrame, probs: Sequence[float] = (0.5,)) -> DataFrame:
    """A (merged) profile as statistics: feature_name, dtype, row_count, null_count, unique_estimate, sample_values,
    mean, std, min, max, and ``quantiles`` (array, one per probability; NULL for other columns than numbers)."""
    filled = F.col("n") - F.col("null_count")
    quantiles = F.when(F.col("quantile_sketch").isNotNull() & (filled > 0), F.array(*[F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(p))) for p in probs]))
    return profiles.select(
        F.col("column_name").alias("feature_name"), "dtype", F.col("n").alias("row_count"), "null_count", F.hll_sketch_estimate("distinct_sketch").alias("unique_estimate"),
        F.coalesce(F.transform("samples", lambda s: s["value"]), F.array().cast("array<string>")).alias("sample_values"), "mean",
        F.when(filled > 1, F.sqrt(F.try_divide(F.col("m2"), filled - 1))).alias("std"), "min", "max", quantiles.alias("quantiles"))
