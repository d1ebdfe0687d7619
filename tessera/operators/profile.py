"""Profiling and validation: one aggregate pass per question asked of a dataset.

Every rule of a declared schema, every null count and the row count are compiled
into a single ``agg`` (partial aggregation per task, one tiny final merge), so a
validation costs one scan however many columns and rules there are.  The
per-column results are unpivoted back to rows with ``inline`` on the one-row
aggregate, which is free.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
TEXT = "text"
BOOLEAN = "boolean"

# The error texts a validation reports, per failed check.
MSG_NOT_NULLABLE = "Column contains null values but is not nullable"
MSG_NOT_UNIQUE = "Column contains duplicate values but should be unique"
MSG_EXPECTED_NUMERIC = "Expected numeric type, got {dtype}"
MSG_BELOW_MIN = "Values below minimum {value}"
MSG_ABOVE_MAX = "Values above maximum {value}"
MSG_INVALID_VALUES = "Invalid values"
MSG_EXPECTED_DATETIME = "Expected datetime type, got {dtype}"
MSG_PATTERN = "Some values don't match pattern: {pattern}"
MSG_COLUMN_NOT_FOUND = "Column not found"
MISSING_COLUMNS_KEY = "__missing_columns__"
ALLOWED_VALUES_CAP = 50  # categorical columns with more distinct values get no list


@dataclass
class ColumnRule:
    """Declared expectations for one column."""

    name: str
    dtype: str = NUMERIC
    nullable: bool = True
    unique: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: Sequence | None = None
    regex_pattern: str | None = None


@dataclass
class CustomRule:
    """A user predicate; rows where it is false count as violations."""

    column: str
    name: str
    predicate: Callable[[Column], Column]


@dataclass
class _Check:
    column: str
    rule: str
    message: str
    violations: Column | None  # None: decided from the schema alone, failed
    static_fail: bool = False


def col_(name: str) -> Column:
    return F.col(f"`{name}`")


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def logical_type(dt: T.DataType) -> str:
    """numeric / datetime / categorical, as the reference's inference decides."""
    if is_numeric(dt):
        return NUMERIC
    if is_datetime(dt):
        return DATETIME
    return CATEGORICAL


def _as_number(name: str, dt: T.DataType) -> Column:
    c = col_(name)
    return c.cast("int") if isinstance(dt, T.BooleanType) else c


def _count(cond: Column, weight: Column | None) -> Column:
    """Rows satisfying ``cond``; with ``weight`` each (grouped) row counts w times."""
    if weight is None:
        return F.count_if(cond).cast("bigint")
    return F.coalesce(F.sum(F.when(cond, weight)), F.lit(0)).cast("bigint")


def _rows(weight: Column | None) -> Column:
    return F.count(F.lit(1)).cast("bigint") if weight is None else F.sum(weight).cast("bigint")


def _schema_checks(
    df: DataFrame,
    schema: Iterable[ColumnRule],
    custom_rules: Iterable[CustomRule] = (),
    weight: Column | None = None,
) -> list[_Check]:
    types = {f.name: f.dataType for f in df.schema.fields}
    checks: list[_Check] = []
    for rule in schema:
        if rule.name not in types:
            checks.append(_Check(MISSING_COLUMNS_KEY, "missing_column", rule.name, None, True))
            continue
        dt = types[rule.name]
        c = col_(rule.name)
        if not rule.nullable:
            checks.append(_Check(rule.name, "not_null", MSG_NOT_NULLABLE, _count(c.isNull(), weight)))
        if rule.unique:
            # distinct non-null values must equal the row count (nulls break uniqueness)
            checks.append(_Check(rule.name, "unique", MSG_NOT_UNIQUE,
                                 _rows(weight) - F.count_distinct(c).cast("bigint")))
        if rule.dtype == NUMERIC:
            if not is_numeric(dt):
                checks.append(_Check(rule.name, "numeric_type",
                                     MSG_EXPECTED_NUMERIC.format(dtype=dt.simpleString()), None, True))
            else:
                x = _as_number(rule.name, dt)
                if rule.min_value is not None:
                    checks.append(_Check(rule.name, "min_value",
                                         MSG_BELOW_MIN.format(value=rule.min_value),
                                         _count(x < F.lit(rule.min_value), weight)))
                if rule.max_value is not None:
                    checks.append(_Check(rule.name, "max_value",
                                         MSG_ABOVE_MAX.format(value=rule.max_value),
                                         _count(x > F.lit(rule.max_value), weight)))
        elif rule.dtype == CATEGORICAL:
            if rule.allowed_values is not None:
                checks.append(_Check(rule.name, "allowed_values", MSG_INVALID_VALUES,
                                     _count(c.isNotNull() & ~c.isin(list(rule.allowed_values)), weight)))
        elif rule.dtype == DATETIME:
            if not is_datetime(dt):
                checks.append(_Check(rule.name, "datetime_type",
                                     MSG_EXPECTED_DATETIME.format(dtype=dt.simpleString()), None, True))
        elif rule.dtype == TEXT:
            if rule.regex_pattern is not None:
                # prefix match, as Python's re.match: anchor at the start only
                pat = f"^(?:{rule.regex_pattern})"
                s = c.cast("string")
                checks.append(_Check(rule.name, "regex", MSG_PATTERN.format(pattern=rule.regex_pattern),
                                     _count(s.isNotNull() & ~s.rlike(pat), weight)))
    for cr in custom_rules:
        if cr.column in types:
            checks.append(_Check(cr.column, "custom", cr.name,
                                 _count(~F.coalesce(cr.predicate(col_(cr.column)), F.lit(False)), weight)))
    return checks


_CHECK_TYPE = "array<struct<column_name:string,rule:string,message:string,violations:bigint,failed:boolean>>"


def _check_structs(checks: list[_Check]) -> Column:
    items = []
    for ch in checks:
        v = ch.violations if ch.violations is not None else F.lit(None).cast("bigint")
        failed = F.lit(True) if ch.static_fail else (v > 0)
        items.append(F.struct(F.lit(ch.column).alias("column_name"), F.lit(ch.rule).alias("rule"),
                              F.lit(ch.message).alias("message"), v.alias("violations"),
                              failed.alias("failed")))
    if not items:
        return F.array().cast(_CHECK_TYPE)
    return F.array(*items)


def validate_schema(
    df: DataFrame,
    schema: Iterable[ColumnRule],
    custom_rules: Iterable[CustomRule] = (),
) -> DataFrame:
    """Failed checks as rows ``(column_name, rule, message, violations)``.

    One aggregate pass; type and missing-column checks come from ``df.schema`` and
    cost no scan.  ``violations`` counts offending rows (NULL for schema-level checks).
    """
    checks = _schema_checks(df, list(schema), list(custom_rules))
    agg = df.agg(_check_structs(checks).alias("checks")) if any(
        c.violations is not None for c in checks
    ) else df.sparkSession.range(1).select(_check_structs(checks).alias("checks"))
    return (agg.select(F.inline("checks"))
            .where("failed")
            .drop("failed"))


def missing_values(df: DataFrame) -> DataFrame:
    """Null count per column: ``(column_name, null_count)``, one pass."""
    structs = [F.struct(F.lit(f.name).alias("column_name"),
                        F.count_if(col_(f.name).isNull()).cast("bigint").alias("null_count"))
               for f in df.schema.fields]
    return df.agg(F.array(*structs).alias("m")).select(F.inline("m"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group (nulls compare equal).

    ``groupBy(all columns)`` combines duplicates map-side before the shuffle, so a
    hot row pattern costs one partial row per task.
    """
    cols = [col_(c) for c in df.columns]
    return (df.groupBy(*cols).count()
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")))


def validation_report(
    df: DataFrame,
    schema: Iterable[ColumnRule],
    custom_rules: Iterable[CustomRule] = (),
) -> DataFrame:
    """valid, total_rows, total_columns, schema_errors, missing_values, duplicate_rows.

    The whole report is one shuffle: rows are first grouped on all columns (the
    duplicate count needs that anyway, and identical rows collapse map-side), then
    every rule, null count and the row count run as weighted sums over the groups.
    """
    schema = list(schema)
    w = F.col("__w")
    grouped = df.groupBy(*[col_(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__w"))
    checks = _schema_checks(df, schema, list(custom_rules), weight=w)
    nulls = F.map_from_arrays(
        F.array(*[F.lit(f.name) for f in df.schema.fields]),
        F.array(*[_count(col_(f.name).isNull(), w) for f in df.schema.fields]),
    )
    agg = grouped.agg(
        _check_structs(checks).alias("checks"),
        F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum(w - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        nulls.alias("missing_values"),
    )
    errors = F.transform(F.filter("checks", lambda s: s["failed"]),
                         lambda s: F.struct(s["column_name"].alias("column_name"), s["rule"].alias("rule"),
                                            s["message"].alias("message"),
                                            s["violations"].alias("violations")))
    return agg.select(
        (F.size(errors) == 0).alias("valid"),
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        errors.alias("schema_errors"),
        "missing_values",
        "duplicate_rows",
    )


def schema_diff_many(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected columns missing from each dataset, over many datasets at once.

    Both sides are ``(dataset, columns array<string>)``; they are exploded to
    ``(dataset, column_name)`` and compared with an anti join.
    """
    e = expected.select("dataset", F.explode("columns").alias("column_name"))
    a = actual.select("dataset", F.explode("columns").alias("column_name"))
    return e.join(a, ["dataset", "column_name"], "left_anti")


def invalid_values(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Distinct non-null values of ``column`` outside ``allowed``: an anti join of the
    distinct values, whatever the length of the list (no hint: a broadcast join where it
    is measured to be small)."""
    vals = df.select(col_(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    allowed_df = df.sparkSession.createDataFrame(
        [(a,) for a in allowed], T.StructType([T.StructField("value", df.schema[column].dataType)]))
    return vals.join(allowed_df, "value", "left_anti")


def zscore_anomalies(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = 3.0,
) -> DataFrame:
    """Adds ``<col>_anomaly``: |x − mean| / std (sample) > threshold.

    Mean and std come from one merged scalar subquery (one aggregate job); null
    values and zero or undefined std give false.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    stats = df.agg(*[F.avg(_as_number(c, df.schema[c].dataType)).alias(f"m{i}") for i, c in enumerate(columns)],
                   *[F.stddev_samp(_as_number(c, df.schema[c].dataType)).alias(f"s{i}")
                     for i, c in enumerate(columns)])
    flags = {}
    for i, c in enumerate(columns):
        x = _as_number(c, df.schema[c].dataType)
        z = F.try_divide(F.abs(x - stats.select(f"m{i}").scalar()), stats.select(f"s{i}").scalar())
        flags[f"{c}_anomaly"] = F.coalesce(z > F.lit(threshold), F.lit(False))
    return df.withColumns(flags)


def anomaly_counts(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Per column: number of z-score anomalies (one pass after the stats job)."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    flagged = zscore_anomalies(df, columns, threshold)
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.count_if(col_(f"{c}_anomaly")).cast("bigint").alias("anomalies"))
               for c in columns]
    return flagged.agg(F.array(*structs).alias("a")).select(F.inline("a"))


# ---------------------------------------------------------------- statistics

def _distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, num, value) for every distinct non-null value of each column.

    Unpivot then ``distinct``: duplicates collapse map-side, so a hot value costs
    one row per task.  ``num`` orders numeric columns numerically.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    items = []
    for c in columns:
        dt = types[c]
        num = _as_number(c, dt).cast("double") if is_numeric(dt) else F.lit(None).cast("double")
        items.append(F.struct(F.lit(c).alias("column_name"), num.alias("num"),
                              col_(c).cast("string").alias("value")))
    return (df.select(F.explode(F.array(*items)).alias("v")).select("v.*")
            .where(F.col("value").isNotNull())
            .distinct())


def _smallest_values(distinct: DataFrame, k: int) -> DataFrame:
    """The k smallest distinct values per column, as one array (group-limited window)."""
    from pyspark.sql import Window

    w = Window.partitionBy("column_name").orderBy(F.col("num").asc_nulls_last(), F.col("value"))
    return (distinct.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
            .groupBy("column_name")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))),
                             lambda s: s["value"]).alias("sample_values")))


def feature_statistics(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    n_samples: int = 5,
) -> DataFrame:
    """Per column: dtype, null_count, unique_count, sample_values, mean, std, min, max.

    Numeric summaries come from one aggregate.  Distinct counts and samples come
    from one unpivot+distinct (exact); ``approx=True`` swaps the distinct count for
    HyperLogLog inside the first aggregate.  Samples are the ``n_samples``
    smallest distinct values, so they do not depend on partitioning.
    """
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in columns:
        dt = types[c]
        x = _as_number(c, dt).cast("double")
        numeric = is_numeric(dt)
        structs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.lit(dt.simpleString()).alias("dtype"),
            F.count_if(col_(c).isNull()).cast("bigint").alias("null_count"),
            (F.approx_count_distinct(col_(c)) if approx else F.lit(None)).cast("bigint").alias("approx_unique"),
            (F.avg(x) if numeric else F.lit(None)).cast("double").alias("mean"),
            (F.stddev_samp(x) if numeric else F.lit(None)).cast("double").alias("std"),
            (F.min(x) if numeric else F.lit(None)).cast("double").alias("min"),
            (F.max(x) if numeric else F.lit(None)).cast("double").alias("max"),
        ))
    base = df.agg(F.array(*structs).alias("s")).select(F.inline("s"))
    distinct = _distinct_values(df, columns)
    samples = _smallest_values(distinct, n_samples)
    out = base.join(samples, "column_name", "left")
    if approx:
        unique = F.col("approx_unique")
    else:
        counts = distinct.groupBy("column_name").agg(F.count(F.lit(1)).cast("bigint").alias("unique_count"))
        out = out.join(counts, "column_name", "left")
        unique = F.coalesce(F.col("unique_count"), F.lit(0)).cast("bigint")
    return out.select(
        F.col("column_name").alias("feature_name"), "dtype", "null_count",
        unique.alias("unique_count"),
        F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
        "mean", "std", "min", "max",
    )


def infer_schema(df: DataFrame, allowed_cap: int = ALLOWED_VALUES_CAP) -> DataFrame:
    """Per column: dtype (logical), nullable, unique, min_value, max_value, allowed_values.

    ``allowed_values`` is the sorted distinct list for categorical columns with at
    most ``allowed_cap`` distinct non-null values (larger lists are not kept, as in
    the reference); the list is built by a group-limited window, never by
    collecting an unbounded set.
    """
    columns = list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in columns:
        dt = types[c]
        x = _as_number(c, dt).cast("double")
        numeric = is_numeric(dt)
        structs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.lit(logical_type(dt)).alias("dtype"),
            (F.count_if(col_(c).isNull()) > 0).alias("nullable"),
            (F.min(x) if numeric else F.lit(None)).cast("double").alias("min_value"),
            (F.max(x) if numeric else F.lit(None)).cast("double").alias("max_value"),
        ))
    base = df.agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.array(*structs).alias("s")).select(
        "n", F.inline("s"))
    distinct = _distinct_values(df, columns)
    counts = distinct.groupBy("column_name").agg(F.count(F.lit(1)).cast("bigint").alias("nunique"))
    lists = _smallest_values(distinct, allowed_cap + 1).withColumnRenamed("sample_values", "vals")
    out = base.join(counts, "column_name", "left").join(lists, "column_name", "left")
    nunique = F.coalesce(F.col("nunique"), F.lit(0))
    return out.select(
        "column_name", "dtype", "nullable",
        (nunique == F.col("n")).alias("unique"),
        "min_value", "max_value",
        F.when((F.col("dtype") == CATEGORICAL) & (nunique <= allowed_cap),
               F.coalesce(F.col("vals"), F.array().cast("array<string>"))).alias("allowed_values"),
    )


def rules_from_inferred(rows: Iterable) -> list[ColumnRule]:
    """Turn collected ``infer_schema`` rows (one per column) into ``ColumnRule``s."""
    out = []
    for r in rows:
        out.append(ColumnRule(name=r["column_name"], dtype=r["dtype"], nullable=bool(r["nullable"]),
                              unique=bool(r["unique"]), min_value=r["min_value"], max_value=r["max_value"],
                              allowed_values=r["allowed_values"]))
    return out


# ---------------------------------------------------------------- statistic checks

def _bias_corrected_skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2)


def _bias_corrected_kurt(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.try_divide((n - 1) * ((n + 1) * F.kurtosis(x) + 6), (n - 2) * (n - 3))


STATISTICS: Mapping[str, Callable[[Column], Column] | None] = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "median": None,  # a rank, not a sum: see ``exact_quantiles``
    "sum": F.sum,
    "count": F.count,
    "nunique": F.count_distinct,
    "skew": _bias_corrected_skew,
    "kurt": _bias_corrected_kurt,
}


def validate_statistics(df: DataFrame, expected: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Each named statistic against an inclusive (lo, hi) range or an exact value.

    Rows ``(column_name, statistic, actual, expected_min, expected_max, passed)``;
    all statistics of all columns are one aggregate, but for medians, which come from ranks
    spread over all tasks (``exact_quantiles``).  A column that does not exist yields one
    failed row with statistic ``__column__``.
    """
    structs, medians = [], []
    for c, stats in expected.items():
        if c not in df.columns:
            structs.append(F.struct(F.lit(c).alias("column_name"), F.lit("__column__").alias("statistic"),
                                    F.lit(None).cast("double").alias("actual"),
                                    F.lit(None).cast("double").alias("expected_min"),
                                    F.lit(None).cast("double").alias("expected_max"),
                                    F.lit(False).alias("passed")))
            continue
        x = _as_number(c, df.schema[c].dataType).cast("double")
        for name, exp in stats.items():
            if name not in STATISTICS:
                raise ValueError(f"unknown statistic {name!r}")
            if STATISTICS[name] is None:
                medians.append(F.struct(F.lit(c).alias("column_name"), x.alias("v")))
                actual = F.lit(None).cast("double")
            else:
                actual = STATISTICS[name](x).cast("double")
            lo, hi = (exp if isinstance(exp, tuple) else (exp, exp))
            passed = F.coalesce((actual >= F.lit(float(lo))) & (actual <= F.lit(float(hi))), F.lit(False))
            structs.append(F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("statistic"),
                                    actual.alias("actual"), F.lit(float(lo)).alias("expected_min"),
                                    F.lit(float(hi)).alias("expected_max"), passed.alias("passed")))
    if not structs:
        return df.sparkSession.createDataFrame(
            [], "column_name string, statistic string, actual double, expected_min double, "
                "expected_max double, passed boolean")
    out = df.agg(F.array(*structs).alias("s")).select(F.inline("s"))
    if not medians:
        return out
    from tessera.operators.ranks import exact_quantiles

    # one row a column
    found = exact_quantiles(df.select(F.inline(F.array(*medians))), ["column_name"], "v", [0.5])
    found = found.select("column_name", F.lit("median").alias("statistic"), F.col("quantiles")[0].alias("median"))
    out = out.join(found, ["column_name", "statistic"], "left")
    actual = F.coalesce("median", "actual")
    passed = F.coalesce(actual.between(F.col("expected_min"), F.col("expected_max")), F.lit(False))
    return out.select("column_name", "statistic", actual.alias("actual"), "expected_min", "expected_max",
                      F.when(F.col("statistic") == "median", passed).otherwise(F.col("passed")).alias("passed"))
