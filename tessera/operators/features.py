"""Feature engineering: fitted transforms and declared feature sets.

Fitting happens in Spark: means/stds are merged scalar subqueries, quantile edges
come from the distributed exact quantile (or ``percentile_approx``), category
lists from a ``distinct`` whose size is checked before it reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterable, Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import transforms as X
from tessera.operators.ranks import exact_quantiles, prefix_sums

MAX_CATEGORIES = 10_000  # width guard for one-hot / label lists brought to the driver


# ---------------------------------------------------------------- imputation

def impute_constant(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls to a constant (0 for scoring, 'missing' for encoding)."""
    return df.na.fill(value, subset=list(columns) if columns else None)


def impute_mean(df: DataFrame, columns: Sequence[str], fit_df: DataFrame | None = None) -> DataFrame:
    """Nulls to the column mean of ``fit_df`` (default ``df``), one merged aggregate."""
    fit_df = fit_df if fit_df is not None else df
    stats = fit_df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), stats.select(f"m{i}").scalar())
                           for i, c in enumerate(columns)})


# ---------------------------------------------------------------- fitted transforms

def standard_scale(df: DataFrame, column: str, output: str, fit_df: DataFrame | None = None) -> DataFrame:
    """(x − mean) / population std; nulls take the mean (→ 0); zero variance → 0."""
    fit_df = fit_df if fit_df is not None else df
    st = fit_df.agg(F.avg(F.col(column).cast("double")).alias("m"),
                    F.stddev_pop(F.col(column).cast("double")).alias("s"))
    m, s = st.select("m").scalar(), st.select("s").scalar()
    x = F.coalesce(F.col(column).cast("double"), m)
    return df.withColumn(output, F.coalesce(F.try_divide(x - m, F.when(s != 0, s)), F.lit(0.0)))


def quantile_edges(df: DataFrame, column: str, q: int = 10, approx: bool = False,
                   digits: int = 9) -> DataFrame:
    """One row ``edges``: sorted distinct quantile edges (q+1 probabilities), rounded."""
    probs = [i / q for i in range(q + 1)]
    if approx:
        e = df.agg(F.percentile_approx(F.col(column).cast("double"), probs, 10_000).alias("quantiles"))
    else:
        e = exact_quantiles(df, [], column, probs)
    return e.select(F.array_sort(F.array_distinct(F.transform("quantiles", lambda t: F.round(t, digits))))
                    .alias("edges"))


def quantile_bin(df: DataFrame, column: str, output: str, q: int = 10, approx: bool = False,
                 fit_df: DataFrame | None = None) -> DataFrame:
    """Quantile bins (duplicate edges dropped, right-closed, 0-based). Not ``ntile``."""
    fit_df = fit_df if fit_df is not None else df
    edges = quantile_edges(fit_df, column, q, approx)
    # attach the edge array once (one scalar subquery), then bin against the column
    e = F.coalesce(edges.select("edges").scalar(), F.array().cast("array<double>"))
    return (df.withColumn("__edges", e)
            .withColumn(output, X.bin_code(F.col(column), F.col("__edges"), q + 1)).drop("__edges"))


def category_list(df: DataFrame, column: str, max_categories: int = MAX_CATEGORIES) -> list[str]:
    """Sorted distinct values (NULL → 'missing'), size-checked before collecting."""
    d = df.select(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("v")).distinct()
    vals = [r[0] for r in d.limit(max_categories + 1).collect()]
    if len(vals) > max_categories:
        raise ValueError(f"{column}: more than {max_categories} categories; use label codes")
    return sorted(vals)


def onehot_encode(df: DataFrame, column: str, output: str, fit_df: DataFrame | None = None) -> DataFrame:
    cats = category_list(fit_df if fit_df is not None else df, column)
    return df.withColumn(output, X.onehot(F.col(column), cats))


def onehot_sparse(df: DataFrame, column: str, output: str, fit_df: DataFrame | None = None) -> DataFrame:
    """One-hot codes of any number of categories: a struct of ``size`` (categories) and
    ``indices`` (the one that is set, in sorted order of the values; none for a value that
    ``fit_df`` lacks).  NULL → 'missing'.

    Same positions as ``onehot_encode``, without its width: codes come from ranks spread over
    all tasks, and no list of categories reaches the driver.
    """
    from tessera.session import checkpoint_dir

    fit_df = fit_df if fit_df is not None else df
    checkpoint_dir(df.sparkSession)
    codes = label_codes(fit_df, column).checkpoint()  # read for the codes and for their number
    size = codes.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    out = _with_codes(df, codes, column).withColumn("__size", size)
    set_ = F.array_compact(F.array("__code"))
    return out.withColumn(output, F.struct(F.col("__size").alias("size"), set_.alias("indices"))).drop("__v", "__code", "__size")


def label_codes(fit_df: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted distinct values → 0-based codes.

    Codes are running counts over the range-partitioned distinct values (the
    two-phase prefix sum), so no task ever holds all of them; the code table is
    joined back and AQE broadcasts it when it is small.
    """
    d = (fit_df.select(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("__v")).distinct()
         .withColumn("__one", F.lit(1.0)))
    return prefix_sums(d, [], "__v", ["__one"]).select("__v", (F.col("cum___one") - 1).cast("int").alias("__code"))


def _with_codes(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """``df`` with ``__v`` (the value, NULL as 'missing') and ``__code``.  Few categories go to the rows, which stay where
    they are: a category can hold most of them, and would be one task of a join by its value."""
    if codes.limit(MAX_CATEGORIES + 1).count() <= MAX_CATEGORIES:
        codes = F.broadcast(codes)
    return df.withColumn("__v", F.coalesce(F.col(column).cast("string"), F.lit("missing"))).join(codes, "__v", "left")


def label_encode(df: DataFrame, column: str, output: str, fit_df: DataFrame | None = None,
                 on_unseen: str = "error") -> DataFrame:
    """Category → 0-based code in sorted order; NULL → 'missing'; unseen → error (or NULL)."""
    out = _with_codes(df, label_codes(fit_df if fit_df is not None else df, column), column)
    code = F.col("__code")
    if on_unseen == "error":
        code = F.when(code.isNotNull(), code).otherwise(
            F.raise_error(F.concat(F.lit(f"unseen category in {column}: "), F.col("__v"))).cast("int"))
    return out.withColumn(output, code).drop("__v", "__code")


# ---------------------------------------------------------------- feature sets

@dataclass
class FeatureDef:
    """One declared feature (the shape stored in the feature registry)."""

    name: str
    feature_type: str  # numeric | categorical | datetime | derived | embedding
    source_column: str | None = None
    transformation: str | None = None
    parameters: Mapping[str, str] = field(default_factory=dict)
    dependencies: Sequence[str] = ()
    description: str = ""
    tags: Mapping[str, str] = field(default_factory=dict)

    @property
    def source(self) -> str:
        return self.source_column or self.name


# The registry's table of feature definitions: one row per feature of a set's version.
DEFINITION_SCHEMA = ("feature_set string, set_version int, name string, feature_type string, source_column string, "
                     "transformation string, parameters map<string,string>, dependencies array<string>, "
                     "description string, tags map<string,string>, created_at timestamp_ntz")
# One row per engineered version of a dataset.
ENGINEERED_SCHEMA = ("engineered_id string, feature_set string, dataset_name string, dataset_version string, "
                     "features_added array<string>, row_count bigint, path string, created_at timestamp_ntz")


def definition_rows(spark, feature_set: str, set_version: int, defs: Iterable[FeatureDef], created_at) -> DataFrame:
    """Registry rows of a feature set's version (append them to the registry table)."""
    return spark.createDataFrame(
        [(feature_set, set_version, d.name, d.feature_type, d.source_column, d.transformation, dict(d.parameters),
          list(d.dependencies), d.description, dict(d.tags), created_at) for d in defs], DEFINITION_SCHEMA)


def definitions(registry: DataFrame, feature_set: str, set_version: int | None = None) -> list[FeatureDef]:
    """The definitions of a feature set, its newest version unless one is named (a row per
    feature of one version, so small)."""
    rows = registry.where(F.col("feature_set") == feature_set)
    if set_version is None:
        newest = rows.agg(F.max("set_version").alias("v"))
        rows = rows.where(F.col("set_version") == newest.scalar())
    else:
        rows = rows.where(F.col("set_version") == set_version)
    out = [FeatureDef(r["name"], r["feature_type"], r["source_column"], r["transformation"], r["parameters"] or {},
                      r["dependencies"] or (), r["description"] or "", r["tags"] or {})
           for r in rows.orderBy("name").collect()]
    if not out:
        raise LookupError(f"no feature set {feature_set!r}" + (f" of version {set_version}" if set_version is not None else ""))
    return out


def materialize_features(df: DataFrame, defs: Iterable[FeatureDef], root: str, dataset_name: str, dataset_version: str,
                         feature_set: str, created_at, table: str | None = None) -> DataFrame:
    """Engineer a dataset version, write it below ``root`` and return its metadata row
    (appended to ``table`` if given); rows are counted in the written files."""
    out, added = engineer_features(df, defs)
    path = f"{root.rstrip('/')}/{dataset_name}/{dataset_version}/{feature_set}"
    out.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(f"{dataset_name}:{dataset_version}:{feature_set}", feature_set, dataset_name, dataset_version, added,
          spark.read.parquet(path).count(), path, created_at)], ENGINEERED_SCHEMA)
    if table:
        meta.write.mode("append").parquet(table)
    return meta


def topological_order(defs: Iterable[FeatureDef]) -> list[FeatureDef]:
    """Declared order, except that a feature follows the features it depends on."""
    defs = list(defs)
    by_name = {d.name: d for d in defs}
    seen: set[str] = set()
    out: list[FeatureDef] = []

    def visit(d: FeatureDef, stack: tuple = ()):
        if d.name in seen:
            return
        if d.name in stack:
            raise ValueError(f"dependency cycle through {d.name}")
        for dep in list(d.dependencies) + ([d.source] if d.source in by_name and d.source != d.name else []):
            if dep in by_name:
                visit(by_name[dep], stack + (d.name,))
        seen.add(d.name)
        out.append(d)

    for d in defs:
        visit(d)
    return out


def apply_feature(df: DataFrame, d: FeatureDef, fit_df: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Apply one definition; returns the frame and the names of columns it added."""
    src, t = d.source, (d.transformation or "").lower()
    if src not in df.columns:
        return df, []
    c = F.col(src)
    if d.feature_type == "derived":
        if t == "log":
            return df.withColumn(d.name, X.log1p(c)), [d.name]
        if t == "sqrt":
            return df.withColumn(d.name, X.sqrt(c)), [d.name]
        if t == "square":
            return df.withColumn(d.name, X.square(c)), [d.name]
        if t == "binning":
            q = int(d.parameters.get("bins", 10))
            approx = str(d.parameters.get("approx", "false")).lower() == "true"
            return quantile_bin(df, src, d.name, q, approx, fit_df), [d.name]
        return df, []  # unknown transformations are left out
    if d.feature_type == "numeric":
        if t in ("standard", "scale", "standard_scale"):
            return standard_scale(df, src, d.name, fit_df), [d.name]
        if not t and d.name != src:
            return df.withColumn(d.name, c), [d.name]
        return df, []
    if d.feature_type == "categorical":
        if t == "onehot":
            return onehot_encode(df, src, d.name, fit_df), [d.name]
        if t in ("label", "label_encode"):
            return label_encode(df, src, d.name, fit_df), [d.name]
        return df, []
    if d.feature_type == "datetime":
        comps = [s.strip() for s in str(d.parameters.get("components", "")).split(",") if s.strip()]
        parts = X.datetime_parts(X.as_timestamp(c), d.name, comps or X.DEFAULT_DATETIME_COMPONENTS)
        return df.withColumns(parts), list(parts)
    if d.feature_type == "embedding":
        if d.name != src:
            return df.withColumn(d.name, c), [d.name]
        return df, []
    return df, []


def engineer_features(df: DataFrame, defs: Iterable[FeatureDef]) -> tuple[DataFrame, list[str]]:
    """Apply a feature set in dependency order; originals are kept.

    Returns the engineered frame (lazy) and the list of added columns (the
    reference reports their count).  A fitted feature fits on the frame as it is
    when its turn comes, so it may read features defined before it.
    """
    out = df
    added: list[str] = []
    for d in topological_order(defs):
        out, new = apply_feature(out, d)
        added += new
    return out, added


# ---------------------------------------------------------------- G2: transformer base

class ColumnTransformerParams(HasInputCol, HasOutputCol):
    method = Param(Params._dummy(), "method", "transform method", typeConverter=TypeConverters.toString)


class FeatureTransformer(Estimator, ColumnTransformerParams, DefaultParamsReadable, DefaultParamsWritable):
    """fit / transform / fit_transform over one column, as a Spark ML Estimator.

    ``method``: standard | binning | onehot | label.  Subclass and override
    ``_fit`` to add a transform; the fitted model holds only small statistics.
    """

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, method: str = "standard"):
        super().__init__()
        self._setDefault(method="standard")
        kwargs = {k: v for k, v in dict(inputCol=inputCol, outputCol=outputCol, method=method).items()
                  if v is not None}
        self._set(**kwargs)

    def _fit(self, dataset: DataFrame) -> "FittedColumnTransformer":
        col, m = self.getInputCol(), self.getOrDefault(self.method)
        if m == "standard":
            st = dataset.agg(F.avg(F.col(col).cast("double")).alias("m"),
                             F.stddev_pop(F.col(col).cast("double")).alias("s")).first()
            state = {"mean": st["m"], "std": st["s"]}
        elif m == "binning":
            state = {"edges": quantile_edges(dataset, col).first()["edges"]}
        elif m in ("onehot", "label"):
            state = {"categories": category_list(dataset, col)}
        else:
            raise ValueError(f"unknown method {m}")
        model = FittedColumnTransformer(col, self.getOutputCol(), m, state)
        return model

    def fit_transform(self, dataset: DataFrame) -> DataFrame:
        return self.fit(dataset).transform(dataset)


class FittedColumnTransformer(Model, ColumnTransformerParams):
    """The fitted side: small state (moments, edges, categories) applied as expressions."""

    def __init__(self, inputCol: str, outputCol: str, method: str, state: dict):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, method=method)
        self.state = state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c, out, m, s = F.col(self.getInputCol()), self.getOutputCol(), self.getOrDefault(self.method), self.state
        if m == "standard":
            mean, std = F.lit(s["mean"]).cast("double"), F.lit(s["std"]).cast("double")
            x = F.coalesce(c.cast("double"), mean)
            return dataset.withColumn(out, F.coalesce(F.try_divide(x - mean, F.when(std != 0, std)),
                                                      F.lit(0.0)))
        if m == "binning":
            edges = s["edges"]
            return dataset.withColumn(out, X.bin_code(c, F.array(*[F.lit(float(e)) for e in edges])
                                                      .cast("array<double>"), len(edges)))
        if m == "onehot":
            return dataset.withColumn(out, X.onehot(c, s["categories"]))
        cats = F.array(*[F.lit(v) for v in s["categories"]])
        key = F.coalesce(c.cast("string"), F.lit("missing"))
        return dataset.withColumn(out, (F.array_position(cats, key) - 1).cast("int"))
