"""Validation and profiling, including the reference's own five validator cases."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import profile as P

# sample_df of the reference's unit tests
SAMPLE = [(25, 50000, "A", 0.5), (30, 60000, "B", 0.6), (35, 70000, "A", 0.7), (40, 80000, "C", 0.8),
          (45, 90000, "B", 0.9)]
SAMPLE_DDL = "age bigint, income bigint, category string, score double"
RULES = [P.ColumnRule("age", P.NUMERIC, nullable=False, min_value=0, max_value=120),
         P.ColumnRule("income", P.NUMERIC, nullable=False, min_value=0),
         P.ColumnRule("category", P.CATEGORICAL, allowed_values=["A", "B", "C"])]


def test_valid_schema_has_no_errors(spark):
    df = spark.createDataFrame(SAMPLE, SAMPLE_DDL)
    assert P.validate_schema(df, RULES).count() == 0


def test_invalid_range_and_category(spark):
    df = spark.createDataFrame([(-5, "A"), (150, "X"), (25, "B")], "age bigint, category string")
    rules = [RULES[0], RULES[2]]
    got = {(r.column_name, r.rule): r.violations for r in P.validate_schema(df, rules).collect()}
    assert got == {("age", "min_value"): 1, ("age", "max_value"): 1, ("category", "allowed_values"): 1}
    bad = P.invalid_values(df, "category", ["A", "B", "C"]).collect()
    assert [r.value for r in bad] == ["X"]


def test_missing_column_reported(spark):
    df = spark.createDataFrame(SAMPLE, SAMPLE_DDL)
    rows = P.validate_schema(df, RULES + [P.ColumnRule("missing_col", P.NUMERIC)]).collect()
    assert [(r.column_name, r.message) for r in rows] == [(P.MISSING_COLUMNS_KEY, "missing_col")]


def test_zscore_threshold_two(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 100]], "value bigint")
    out = P.zscore_anomalies(df, ["value"], 2.0).orderBy("value").collect()
    assert [r.value for r in out if r.value_anomaly] == [100]
    # mean 19.1667, sample std 39.6253 → z(100) = 2.0400
    z = abs(100 - 115 / 6) / 39.62532
    assert math.isclose(z, 2.04, abs_tol=1e-3)


def test_report_valid_five_rows(spark):
    df = spark.createDataFrame(SAMPLE, SAMPLE_DDL)
    rep = P.validation_report(df, RULES).first()
    assert rep.valid and rep.total_rows == 5 and rep.total_columns == 4 and rep.duplicate_rows == 0
    assert rep.missing_values == {"age": 0, "income": 0, "category": 0, "score": 0}


def test_report_counts_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "k int, v string")
    rep = P.validation_report(df, [P.ColumnRule("v", P.TEXT, nullable=False)]).first()
    assert rep.duplicate_rows == 3 and rep.missing_values["v"] == 2 and not rep.valid
    assert rep.schema_errors[0].violations == 2


def test_unique_rule_counts_nulls_as_breaking(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    rows = P.validate_schema(df, [P.ColumnRule("k", P.NUMERIC, unique=True)]).collect()
    assert rows[0].rule == "unique" and rows[0].violations == 1


def test_regex_is_prefix_match(spark):
    df = spark.createDataFrame([("abc",), ("xab",), (None,)], "t string")
    rows = P.validate_schema(df, [P.ColumnRule("t", P.TEXT, regex_pattern="ab")]).collect()
    assert rows[0].violations == 1


def test_custom_rule(spark):
    df = spark.createDataFrame(SAMPLE, SAMPLE_DDL)
    rows = P.validate_schema(df, [], [P.CustomRule("score", "score below 0.8", lambda c: c < 0.8)]).collect()
    assert rows[0].violations == 2


def test_empty_frame_and_all_null_column(spark):
    df = spark.createDataFrame([], "x double, c string")
    st = {r.feature_name: r for r in P.feature_statistics(df).collect()}
    assert st["x"].null_count == 0 and st["x"].unique_count == 0 and st["x"].mean is None
    nulls = spark.createDataFrame([(None,), (None,)], "x double")
    st = P.feature_statistics(nulls).first()
    assert st.null_count == 2 and st.unique_count == 0 and st.sample_values == []


def test_feature_statistics_samples_are_smallest(spark):
    df = spark.createDataFrame([(float(v),) for v in [9, 3, 3, 7, 1, 5, 2]], "x double")
    st = P.feature_statistics(df).first()
    assert st.sample_values == ["1.0", "2.0", "3.0", "5.0", "7.0"]
    assert st.unique_count == 6 and math.isclose(st.std, 2.8702082220799308, rel_tol=1e-12)


def test_single_row_std_is_null(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert P.feature_statistics(df).first().std is None


def test_nan_is_null_at_the_boundary(spark, tmp_path):
    from tessera.sources.tables import nan_to_null
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert df.where(F.col("x").isNull()).count() == 1


def test_infer_schema(spark):
    df = spark.createDataFrame(SAMPLE, SAMPLE_DDL)
    s = {r.column_name: r for r in P.infer_schema(df).collect()}
    assert s["age"].dtype == "numeric" and s["age"].unique and not s["age"].nullable
    assert s["category"].allowed_values == ["A", "B", "C"] and not s["category"].unique
    assert s["age"].min_value == 25.0 and s["age"].max_value == 45.0


def test_validate_statistics_bias_corrected(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = {r.statistic: r for r in P.validate_statistics(df, {"x": {"skew": (-9, 9), "kurt": (-9, 9)},
                                                              "nope": {"mean": (0, 1)}}).collect()}
    # bias-corrected sample skewness / excess kurtosis of [1, 2, 3, 4, 10] (pandas' definitions)
    assert math.isclose(rows["skew"].actual, 1.697056274847714, rel_tol=1e-9)
    assert math.isclose(rows["kurt"].actual, 3.152, rel_tol=1e-9)
    assert rows["__column__"].passed is False


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_report_is_partition_invariant(spark, parts):
    from tests.conftest import SF_SMALL
    from tessera.sources.tables import load
    li = load(spark, SF_SMALL, "lineitem").repartition(parts)
    rep = P.validation_report(li, [P.ColumnRule("l_quantity", P.NUMERIC, max_value=40.0)]).first()
    base = P.validation_report(load(spark, SF_SMALL, "lineitem"),
                               [P.ColumnRule("l_quantity", P.NUMERIC, max_value=40.0)]).first()
    assert rep == base
