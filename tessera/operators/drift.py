"""Drift statistics: reference vs current, all columns in one job.

Both sides are stacked with a side flag and unpivoted to ``(feature, value)``
once; every test then groups by feature:

* KS: distinct values per feature with per-side counts (combined map-side), the
  two ECDFs from one distributed prefix sum, D = max gap, asymptotic p-value;
* chi-square: per-category counts of both sides (one grouped aggregate over the
  union of categories, no join), expected = ref · n_cur / n_ref;
* PSI: bins from the reference's quantile edges (numeric) or categories.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import stats as S
from tessera.functions.transforms import bin_code
from tessera.operators.profile import is_numeric
from tessera.operators.ranks import prefix_sums, quantiles_from_ranked
from tessera.session import checkpoint_dir

REF, CUR = "reference", "current"
# Default thresholds (data drift share, prediction drift p, accuracy drop).
DATA_DRIFT_THRESHOLD = 0.1
PREDICTION_DRIFT_THRESHOLD = 0.1
PERFORMANCE_DEGRADATION_THRESHOLD = 0.05
# Rows of a model's log that its report looks at, and the types judged by the p-value of one column.
NEWEST_ROWS = 1000
ONE_COLUMN_TYPES = ("prediction_drift", "concept_drift")


def stack_sides(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Reference and current rows with a ``side`` flag (one scan feeds every test)."""
    cols = list(columns) if columns else [c for c in reference.columns if c in current.columns]
    return (reference.select(*cols).withColumn("side", F.lit(REF))
            .unionByName(current.select(*cols).withColumn("side", F.lit(CUR))))


def split_columns(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in columns if is_numeric(types[c])]
    cat = [c for c in columns if c not in num]
    return num, cat


def _join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``cols``; with more than ``feature`` in it, NULL keys meet each other."""
    if list(cols) == ["feature"]:
        return left.join(right, "feature", how)
    r = right.withColumnsRenamed({c: f"__{c}" for c in cols})
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols]
    return left.join(r, cond, how).drop(*[f"__{c}" for c in cols])


def _long_numeric(stacked: DataFrame, columns: Sequence[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]
    return stacked.select("side", F.inline(F.array(*items))).where(F.col("v").isNotNull())


def _long_categorical(stacked: DataFrame, columns: Sequence[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns]
    return stacked.select("side", F.inline(F.array(*items))).where(F.col("v").isNotNull())


def _side_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("feature", "v").agg(
        F.sum(F.when(F.col("side") == REF, 1.0).otherwise(0.0)).alias("n_ref"),
        F.sum(F.when(F.col("side") == CUR, 1.0).otherwise(0.0)).alias("n_cur"))


def ranked_sides(stacked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature and distinct value: counts and running counts on both sides, with
    side totals -- one distributed prefix sum that KS and PSI both read."""
    counts = _side_counts(_long_numeric(stacked, columns))
    return prefix_sums(counts, ["feature"], "v", ["n_ref", "n_cur"], materialize=True)


def ecdf(stacked: DataFrame, columns: Sequence[str], ranked: DataFrame | None = None,
         keys: Sequence[str] = ()) -> DataFrame:
    """Per feature and distinct value: cumulative share on each side."""
    cum = ranked if ranked is not None else ranked_sides(stacked, columns)
    return cum.select(
        *keys, "feature", "v", F.try_divide(F.col("cum_n_ref"), F.col("total_n_ref")).alias("cdf_ref"),
        F.try_divide(F.col("cum_n_cur"), F.col("total_n_cur")).alias("cdf_cur"),
        F.col("total_n_ref").alias("N"), F.col("total_n_cur").alias("M"))


def ks_test(stacked: DataFrame, columns: Sequence[str], threshold: float = PREDICTION_DRIFT_THRESHOLD,
            ranked: DataFrame | None = None, keys: Sequence[str] = (), method: str = "auto") -> DataFrame:
    """Two-sample KS per numeric feature: statistic D, p-value, score = 1 − p.  ``method``: how the
    p-value is found (``stats.ks_pvalue_by``), exactly for small samples by default."""
    e = ecdf(stacked, columns, ranked, keys)
    d = e.groupBy(*keys, "feature", F.col("N").alias("n_ref"), F.col("M").alias("n_cur")).agg(
        F.max(F.abs(F.coalesce("cdf_ref", F.lit(0.0)) - F.coalesce("cdf_cur", F.lit(0.0)))).alias("statistic"))
    if keys and method != "asymptotic":  # the work lies in the tests: dealt out, however few bytes they are
        d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p = S.ks_pvalue_by(method, F.col("statistic"), F.col("n_ref"), F.col("n_cur"))
    return d.select(*keys, "feature", F.lit("ks").alias("test"), "statistic", p.alias("p_value"),
                    F.col("n_ref").cast("bigint").alias("n_ref"), F.col("n_cur").cast("bigint").alias("n_cur")
                    ).withColumn("drift_score", 1 - F.col("p_value")).withColumn(
        "drift_detected", F.coalesce(F.col("p_value") < threshold, F.lit(False)))


def category_counts(stacked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature and category: counts on both sides over the union of categories."""
    return _side_counts(_long_categorical(stacked, columns)).withColumnRenamed("v", "category")


def chi_square_test(stacked: DataFrame, columns: Sequence[str], threshold: float = PREDICTION_DRIFT_THRESHOLD,
                    categories: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Goodness of fit of current counts to reference shares, per categorical feature.

    expected = ref · n_cur / n_ref; a category never seen in the reference makes
    the statistic infinite (p = 0); dof = categories − 1.
    """
    cc = categories if categories is not None else category_counts(stacked, columns)
    tot = cc.groupBy(*keys, "feature").agg(F.sum("n_ref").alias("N"), F.sum("n_cur").alias("M"),
                                    F.count(F.lit(1)).alias("k"))
    j = _join_on(cc, tot, [*keys, "feature"])
    expected = F.col("n_ref") * F.try_divide(F.col("M"), F.col("N"))
    term = F.when(expected > 0, (F.col("n_cur") - expected) ** 2 / expected).when(
        F.col("n_cur") > 0, F.lit(float("inf"))).otherwise(0.0)
    agg = j.groupBy(*keys, "feature", "N", "M", "k").agg(F.sum(term).alias("statistic"))
    p = S.chi2_sf(F.col("statistic"), F.col("k") - 1)
    return agg.select(*keys, "feature", F.lit("chi_square").alias("test"), "statistic", p.alias("p_value"),
                      F.col("N").cast("bigint").alias("n_ref"), F.col("M").cast("bigint").alias("n_cur")
                      ).withColumn("drift_score", 1 - F.col("p_value")).withColumn(
        "drift_detected", F.coalesce(F.col("p_value") < threshold, F.lit(False)))


def psi(stacked: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), bins: int = 10,
        eps: float = S.PSI_EPS, ranked: DataFrame | None = None, categories: DataFrame | None = None,
        keys: Sequence[str] = ()) -> DataFrame:
    """Population stability index per feature.

    Numeric bins are the reference's quantile edges (exact), read off the ranked
    distinct-value table that KS also uses; each distinct value is binned once
    (a fixed-width expression, no lambda) and its per-side counts are summed per
    bin, so the raw rows are never scanned again.  Categorical bins are the
    categories, from the same per-category counts as chi-square.
    """
    parts, by = [], [*keys, "feature"]
    if numeric:
        probs = [i / bins for i in range(bins + 1)]
        rk = ranked if ranked is not None else ranked_sides(stacked, numeric)
        edges = quantiles_from_ranked(rk, by, "v", "n_ref", "cum_n_ref", "total_n_ref", probs).select(
            *by, F.array_sort(F.array_distinct("quantiles")).alias("edges"))
        code = bin_code(F.col("v"), F.col("edges"), bins + 1)
        parts.append(_join_on(rk, edges, by).select(*by, code.cast("string").alias("bin"),
                                                    F.col("n_ref").alias("r"), F.col("n_cur").alias("c")))
    if categorical:
        cc = categories if categories is not None else category_counts(stacked, categorical)
        parts.append(cc.select(*by, F.col("category").alias("bin"), F.col("n_ref").alias("r"),
                               F.col("n_cur").alias("c")))
    if not parts:
        raise ValueError("no columns")
    binned = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    counts = binned.groupBy(*by, "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    tot = counts.groupBy(*by).agg(F.sum("r").alias("r_total"), F.sum("c").alias("c_total"))
    j = _join_on(counts, tot, by)
    term = S.psi_term(F.try_divide(F.col("c"), F.col("c_total")), F.try_divide(F.col("r"), F.col("r_total")), eps)
    return j.groupBy(*by).agg(F.sum(term).alias("psi"), F.count(F.lit(1)).alias("n_bins"))


def side_counts_all(stacked: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Per feature and distinct value, the count on each side, for numeric and
    categorical columns together: one unpivot and one grouped aggregate, i.e. one
    pass over the raw rows whatever the number of columns and tests.  The result
    (distinct values only) is checkpointed so every test reads it, not the data.
    """
    items = ([F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("num"),
                       F.lit(None).cast("string").alias("cat")) for c in numeric]
             + [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("num"),
                         F.col(c).cast("string").alias("cat")) for c in categorical])
    long = stacked.select(*keys, "side", F.inline(F.array(*items))).where(
        F.col("num").isNotNull() | F.col("cat").isNotNull())
    counts = long.groupBy(*keys, "feature", "num", "cat").agg(
        F.sum(F.when(F.col("side") == REF, 1.0).otherwise(0.0)).alias("n_ref"),
        F.sum(F.when(F.col("side") == CUR, 1.0).otherwise(0.0)).alias("n_cur"))
    checkpoint_dir(stacked.sparkSession)
    return counts.checkpoint(eager=True)


def data_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None,
               threshold: float = DATA_DRIFT_THRESHOLD, p_threshold: float = PREDICTION_DRIFT_THRESHOLD,
               with_psi: bool = True, keys: Sequence[str] = (), method: str = "auto") -> DataFrame:
    """Per column: test (KS numeric / chi-square categorical), statistic, p, score, flag, PSI.

    With ``keys`` (columns of both sides) that for every key by itself, all in the same jobs;
    the names ``feature``, ``num``, ``cat``, ``v`` and ``side`` are taken."""
    keys = list(keys)
    stacked = stack_sides(reference, current, [*keys, *columns] if columns else None)
    cols = [c for c in stacked.columns if c != "side" and c not in keys]
    num, cat = split_columns(stacked, cols)
    parts, by = [], [*keys, "feature"]
    counts = side_counts_all(stacked, num, cat, keys)
    ranked = (prefix_sums(counts.where(F.col("num").isNotNull()).select(*by, F.col("num").alias("v"),
                                                                       "n_ref", "n_cur"),
                          by, "v", ["n_ref", "n_cur"], materialize=True) if num else None)
    cats = (counts.where(F.col("cat").isNotNull()).select(*by, F.col("cat").alias("category"), "n_ref", "n_cur")
            if cat else None)
    if num:
        parts.append(ks_test(stacked, num, p_threshold, ranked, keys, method))
    if cat:
        parts.append(chi_square_test(stacked, cat, p_threshold, cats, keys))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if with_psi:
        out = _join_on(out, psi(stacked, num, cat, ranked=ranked, categories=cats, keys=keys), by, "left")
    return out


def drift_summary(per_feature: DataFrame, threshold: float = DATA_DRIFT_THRESHOLD) -> DataFrame:
    """Dataset-level: share of drifted columns; detected when share > threshold."""
    return per_feature.agg(
        F.count(F.lit(1)).alias("features_analyzed"),
        F.count_if("drift_detected").alias("features_drifted"),
        (F.count_if("drift_detected") / F.count(F.lit(1))).alias("drift_score"),
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("feature")))).alias("drifted_features"),
        F.map_from_entries(F.collect_list(F.struct("feature", "drift_score"))).alias("feature_scores"),
    ).withColumn("drift_detected", F.col("drift_score") > threshold).withColumn("threshold", F.lit(threshold))


def prediction_drift(reference: DataFrame, current: DataFrame, column: str = "prediction",
                     threshold: float = PREDICTION_DRIFT_THRESHOLD, method: str = "auto") -> DataFrame:
    """KS if the prediction column is numeric, else chi-square."""
    stacked = stack_sides(reference.select(column), current.select(column))
    if is_numeric(stacked.schema[column].dataType):
        return ks_test(stacked, [column], threshold, method=method)
    return chi_square_test(stacked, [column], threshold)


def concept_drift(reference: DataFrame, current: DataFrame, target_col: str,
                  threshold: float = PREDICTION_DRIFT_THRESHOLD, method: str = "auto") -> DataFrame:
    """Drift of the target column (D6): same dispatch as prediction drift."""
    return prediction_drift(reference, current, target_col, threshold, method)


def drift_report(reference: DataFrame, log: DataFrame, columns: Mapping[str, Sequence[str]], created_at,
                 newest: int | None = NEWEST_ROWS, threshold: float = DATA_DRIFT_THRESHOLD,
                 p_threshold: float = PREDICTION_DRIFT_THRESHOLD, ts_col: str = "timestamp",
                 id_col: str = "prediction_id") -> DataFrame:
    """One drift_reports row per model of ``log`` and drift type (D8): id, flags, scores, time.

    ``columns`` gives the columns of each drift type.  The current side is the ``newest``
    rows of each model (None: all its rows), the reference side that model's rows of
    ``reference``.  Prediction and concept drift are judged by the p-value of their column
    (score 1 − p), the others by the share of drifted columns.  The version is that of the
    model's newest row.  A model or type without values to compare gives a report of no columns.
    """
    current = log
    if newest is not None:
        w = Window.partitionBy("model_name").orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
        current = log.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= newest).drop("__rn")
    every = list(dict.fromkeys(c for cols in columns.values() for c in cols))
    checks = data_drift(reference, current, every, p_threshold=p_threshold, with_psi=False, keys=["model_name"])
    types = F.array_compact(F.array(*[F.when(F.col("feature").isin(list(c)), F.lit(t)) for t, c in columns.items()]))
    per_type = checks.withColumn("drift_type", F.explode(types)).groupBy("model_name", "drift_type").agg(
        F.count(F.lit(1)).alias("n_features"), (F.count_if("drift_detected") / F.count(F.lit(1))).alias("share"),
        F.max("drift_score").alias("largest"), F.bool_or("drift_detected").alias("any"),
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("feature")))).alias("drifted_features"),
        F.map_from_entries(F.collect_list(F.struct("feature", "drift_score"))).alias("feature_scores"))
    models = log.groupBy("model_name").agg(
        F.max_by("model_version", F.struct(ts_col, id_col)).alias("model_version"))
    grid = models.withColumn("drift_type", F.explode(F.array(*[F.lit(t) for t in columns])))
    s = _join_on(grid, per_type, ["model_name", "drift_type"], "left")
    one = F.col("drift_type").isin(*ONE_COLUMN_TYPES)
    part = [F.coalesce(c, F.lit("")) for c in ("model_name", "model_version", "drift_type")]
    rid = F.concat(F.lit("drift-"), F.substring(F.sha2(F.concat_ws("|", *part, F.lit(str(created_at))), 256), 1, 12))
    return s.select(
        rid.alias("report_id"), "model_name", "model_version", "drift_type",
        F.coalesce(F.when(one, F.col("any")).otherwise(F.col("share") > threshold), F.lit(False)).alias("drift_detected"),
        F.when(one, F.col("largest")).otherwise(F.col("share")).alias("drift_score"),
        F.when(one, F.lit(p_threshold)).otherwise(F.lit(threshold)).alias("threshold"),
        F.coalesce("n_features", F.lit(0)).cast("int").alias("n_features"),
        F.coalesce("drifted_features", F.array().cast("array<string>")).alias("drifted_features"),
        F.coalesce("feature_scores", F.create_map().cast("map<string,double>")).alias("feature_scores"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"))


MAX_FEATURE_KEYS = 10_000


def flatten_features(df: DataFrame, json_col: str, keys: Sequence[str] | None = None,
                     value_type: str = "double") -> DataFrame:
    """Features document → one column per key.

    Keys are given, or discovered with ``json_object_keys`` + ``distinct``: a set
    of feature names (not values), checked against ``MAX_FEATURE_KEYS`` before it
    reaches the driver -- more keys than that cannot become columns anyway, so
    the call fails instead of silently dropping any.
    """
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(), T.StringType()))
    if keys is None:
        found = [r[0] for r in df.select(F.explode(F.json_object_keys(json_col)).alias("k"))
                 .distinct().limit(MAX_FEATURE_KEYS + 1).collect()]
        if len(found) > MAX_FEATURE_KEYS:
            raise ValueError(f"{json_col}: more than {MAX_FEATURE_KEYS} distinct feature keys")
        keys = sorted(found)
    return df.withColumn("__m", m).withColumns(
        {k: F.col("__m").getItem(k).cast(value_type) for k in keys}).drop("__m")
