"""Profiling / validation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.plans.common import joined, query, r6, round_doubles, tbl

# One declared schema over lineitem, exercising every rule kind.  ``l_tax`` gets
# nulls (0 → NULL) so the not-null rule has something to find.
LINEITEM_RULES = [
    P.ColumnRule("l_orderkey", P.NUMERIC, nullable=False, min_value=0.0),
    P.ColumnRule("l_linenumber", P.NUMERIC, unique=True),
    P.ColumnRule("l_quantity", P.NUMERIC, min_value=1.0, max_value=49.0),
    P.ColumnRule("l_discount", P.NUMERIC, min_value=0.0, max_value=0.08),
    P.ColumnRule("l_tax", P.NUMERIC, nullable=False),
    P.ColumnRule("l_returnflag", P.CATEGORICAL, allowed_values=["A", "N"]),
    P.ColumnRule("l_linestatus", P.TEXT, regex_pattern="F"),
    P.ColumnRule("l_shipdate", P.DATETIME),
    P.ColumnRule("l_partkey", P.DATETIME),
    P.ColumnRule("l_returnflag", P.NUMERIC),
    P.ColumnRule("l_comment", P.TEXT),
]
CUSTOM = [P.CustomRule("l_extendedprice", "extendedprice under 100000", lambda c: c < 100000)]


def _lineitem_nulls(spark, sf):
    li = tbl(spark, sf, "lineitem")
    return li.withColumn("l_tax", F.when(F.col("l_tax") != 0, F.col("l_tax")))


LINEITEM_NULLS_SQL = """
with t as (select * replace (nullif(l_tax, 0) as l_tax) from lineitem)
"""

CHECKS_SQL = LINEITEM_NULLS_SQL + """,
c as (
  select 'l_orderkey' column_name, 'not_null' rule,
         'Column contains null values but is not nullable' message,
         count(*) filter (where l_orderkey is null) violations, false static from t
  union all select 'l_orderkey', 'min_value', 'Values below minimum 0.0',
         count(*) filter (where l_orderkey < 0), false from t
  union all select 'l_linenumber', 'unique', 'Column contains duplicate values but should be unique',
         count(*) - count(distinct l_linenumber), false from t
  union all select 'l_quantity', 'min_value', 'Values below minimum 1.0',
         count(*) filter (where l_quantity < 1.0), false from t
  union all select 'l_quantity', 'max_value', 'Values above maximum 49.0',
         count(*) filter (where l_quantity > 49.0), false from t
  union all select 'l_discount', 'min_value', 'Values below minimum 0.0',
         count(*) filter (where l_discount < 0.0), false from t
  union all select 'l_discount', 'max_value', 'Values above maximum 0.08',
         count(*) filter (where l_discount > 0.08), false from t
  union all select 'l_tax', 'not_null', 'Column contains null values but is not nullable',
         count(*) filter (where l_tax is null), false from t
  union all select 'l_returnflag', 'allowed_values', 'Invalid values',
         count(*) filter (where l_returnflag is not null and l_returnflag not in ('A', 'N')), false from t
  union all select 'l_linestatus', 'regex', 'Some values don''t match pattern: F',
         count(*) filter (where l_linestatus is not null and not regexp_matches(l_linestatus, '^(?:F)')), false from t
  union all select 'l_partkey', 'datetime_type', 'Expected datetime type, got bigint', null, true
  union all select 'l_returnflag', 'numeric_type', 'Expected numeric type, got string', null, true
  union all select '__missing_columns__', 'missing_column', 'l_comment', null, true
  union all select 'l_extendedprice', 'custom', 'extendedprice under 100000',
         count(*) filter (where not coalesce(l_extendedprice < 100000, false)), false from t
)
"""


@query("validate_schema", CHECKS_SQL + """
select column_name, rule, message, cast(violations as bigint) violations from c
where static or violations > 0
""")
def validate_schema(spark, sf):
    return P.validate_schema(_lineitem_nulls(spark, sf), LINEITEM_RULES, CUSTOM)


@query("validation_report", CHECKS_SQL + """
select (select count(*) from c where static or violations > 0) = 0 as valid,
       (select count(*) from t) as total_rows,
       cast(11 as bigint) as total_columns,
       (select count(*) from c where static or violations > 0) as n_errors,
       (select cast(count(*) filter (where l_tax is null) as bigint) from t) as null_cells,
       (select count(*) from t) - (select count(*) from (select distinct * from t)) as duplicate_rows
""")
def validation_report(spark, sf):
    rep = P.validation_report(_lineitem_nulls(spark, sf), LINEITEM_RULES, CUSTOM)
    return rep.select(
        "valid", "total_rows", "total_columns",
        F.size("schema_errors").cast("bigint").alias("n_errors"),
        F.aggregate(F.map_values("missing_values"), F.lit(0).cast("bigint"),
                    lambda a, b: a + b).alias("null_cells"),
        "duplicate_rows",
    )


CUSTOMER_NULLS_SQL = """
with t as (
  select c_custkey, c_name, c_nationkey,
         case when c_acctbal >= 0 then c_acctbal end as c_acctbal,
         nullif(c_mktsegment, 'BUILDING') as c_mktsegment
  from customer)
"""


def _customer_nulls(spark, sf):
    c = tbl(spark, sf, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey",
                    F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"))


@query("missing_values", CUSTOMER_NULLS_SQL + """
select 'c_custkey' column_name, count(*) filter (where c_custkey is null) null_count from t
union all select 'c_name', count(*) filter (where c_name is null) from t
union all select 'c_nationkey', count(*) filter (where c_nationkey is null) from t
union all select 'c_acctbal', count(*) filter (where c_acctbal is null) from t
union all select 'c_mktsegment', count(*) filter (where c_mktsegment is null) from t
""")
def missing_values(spark, sf):
    return P.missing_values(_customer_nulls(spark, sf))


@query("duplicate_rows", """
select cast(count(*) - (select count(*) from (select distinct l_returnflag, l_linestatus, l_quantity
                                              from lineitem)) as bigint) duplicate_rows
from lineitem
""")
def duplicate_rows(spark, sf):
    return P.duplicate_rows(tbl(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


STAT_COLS = ["l_quantity", "l_discount", "l_returnflag", "l_shipdate", "l_linenumber", "l_tax"]


@query("feature_statistics", LINEITEM_NULLS_SQL + """,
u as (
  select 'l_quantity' c, l_quantity::double num, l_quantity::varchar v from t
  union all select 'l_discount', l_discount::double, l_discount::varchar from t
  union all select 'l_returnflag', null, l_returnflag from t
  union all select 'l_shipdate', null, l_shipdate::varchar from t
  union all select 'l_linenumber', l_linenumber::double, l_linenumber::varchar from t
  union all select 'l_tax', l_tax::double, l_tax::varchar from t
),
d as (select distinct c, num, v from u where v is not null),
r as (select c, v, row_number() over (partition by c order by num asc nulls last, v) rn from d),
s as (select c, string_agg(v, ',' order by rn) sample_values, from r where rn <= 5 group by c),
n as (select c, count(*) unique_count from d group by c),
base as (
  select 'l_quantity' c, 'double' dtype, count(*) filter (where l_quantity is null) null_count,
         avg(l_quantity) mean, stddev_samp(l_quantity) std, min(l_quantity) mn, max(l_quantity) mx from t
  union all select 'l_discount', 'double', count(*) filter (where l_discount is null),
         avg(l_discount), stddev_samp(l_discount), min(l_discount), max(l_discount) from t
  union all select 'l_returnflag', 'string', count(*) filter (where l_returnflag is null),
         null, null, null, null from t
  union all select 'l_shipdate', 'timestamp_ntz', count(*) filter (where l_shipdate is null),
         null, null, null, null from t
  union all select 'l_linenumber', 'int', count(*) filter (where l_linenumber is null),
         avg(l_linenumber), stddev_samp(l_linenumber), min(l_linenumber), max(l_linenumber) from t
  union all select 'l_tax', 'double', count(*) filter (where l_tax is null),
         avg(l_tax), stddev_samp(l_tax), min(l_tax), max(l_tax) from t
)
select base.c feature_name, dtype, cast(null_count as bigint) null_count,
       cast(coalesce(n.unique_count, 0) as bigint) unique_count,
       coalesce(s.sample_values, '') sample_values,
       round(mean, 5) mean, round(std, 5) std, round(mn, 5) "min", round(mx, 5) "max"
from base left join s on s.c = base.c left join n on n.c = base.c
""")
def feature_statistics(spark, sf):
    st = P.feature_statistics(_lineitem_nulls(spark, sf), STAT_COLS)
    # 5 places: the mean of l_discount sits exactly on a 6th-place half at sf0.01
    return round_doubles(st.withColumn("sample_values", joined("sample_values")), 5)


@query("infer_schema", CUSTOMER_NULLS_SQL + """,
u as (
  select 'c_custkey' c, c_custkey::double num, c_custkey::varchar v from t
  union all select 'c_name', null, c_name from t
  union all select 'c_nationkey', c_nationkey::double, c_nationkey::varchar from t
  union all select 'c_acctbal', c_acctbal::double, c_acctbal::varchar from t
  union all select 'c_mktsegment', null, c_mktsegment from t
),
d as (select distinct c, num, v from u where v is not null),
n as (select c, count(*) nunique, string_agg(v, ',' order by num asc nulls last, v) vals from d group by c),
base as (
  select 'c_custkey' c, 'numeric' dtype, count(*) filter (where c_custkey is null) > 0 nullable,
         min(c_custkey)::double mn, max(c_custkey)::double mx, count(*) total from t
  union all select 'c_name', 'categorical', count(*) filter (where c_name is null) > 0, null, null, count(*) from t
  union all select 'c_nationkey', 'numeric', count(*) filter (where c_nationkey is null) > 0,
         min(c_nationkey), max(c_nationkey), count(*) from t
  union all select 'c_acctbal', 'numeric', count(*) filter (where c_acctbal is null) > 0,
         min(c_acctbal), max(c_acctbal), count(*) from t
  union all select 'c_mktsegment', 'categorical', count(*) filter (where c_mktsegment is null) > 0,
         null, null, count(*) from t
)
select base.c column_name, dtype, nullable, coalesce(n.nunique, 0) = total as "unique",
       round(mn, 6) min_value, round(mx, 6) max_value,
       case when dtype = 'categorical' and coalesce(n.nunique, 0) <= 50 then coalesce(n.vals, '') end
         as allowed_values
from base left join n on n.c = base.c
""")
def infer_schema(spark, sf):
    s = P.infer_schema(_customer_nulls(spark, sf))
    return round_doubles(s.withColumn("allowed_values", joined("allowed_values")))


EXPECTED_STATS = {
    "l_quantity": {"mean": (20.0, 30.0), "std": (0.0, 10.0), "median": (25.0, 26.0),
                   "skew": (-0.1, 0.1), "kurt": (-2.0, 0.0), "var": (0.0, 100.0)},
    "l_discount": {"max": 0.1, "min": 0.0, "nunique": (10.0, 12.0), "count": (0.0, 1e9), "sum": (0.0, 1e9)},
    "l_nosuch": {"mean": (0.0, 1.0)},
}


@query("validate_statistics", """
with s as (
  select 'l_quantity' column_name, 'mean' statistic, avg(l_quantity) actual, 20.0 lo, 30.0 hi from lineitem
  union all select 'l_quantity', 'std', stddev_samp(l_quantity), 0.0, 10.0 from lineitem
  union all select 'l_quantity', 'median', quantile_cont(l_quantity, 0.5), 25.0, 26.0 from lineitem
  union all select 'l_quantity', 'skew', skewness(l_quantity), -0.1, 0.1 from lineitem
  union all select 'l_quantity', 'kurt', kurtosis(l_quantity), -2.0, 0.0 from lineitem
  union all select 'l_quantity', 'var', var_samp(l_quantity), 0.0, 100.0 from lineitem
  union all select 'l_discount', 'max', max(l_discount), 0.1, 0.1 from lineitem
  union all select 'l_discount', 'min', min(l_discount), 0.0, 0.0 from lineitem
  union all select 'l_discount', 'nunique', count(distinct l_discount), 10.0, 12.0 from lineitem
  union all select 'l_discount', 'count', count(l_discount), 0.0, 1e9 from lineitem
  union all select 'l_discount', 'sum', sum(l_discount), 0.0, 1e9 from lineitem
)
select column_name, statistic, round(actual, 6) actual, lo expected_min, hi expected_max,
       coalesce(actual >= lo and actual <= hi, false) passed from s
union all select 'l_nosuch', '__column__', null, null, null, false
""")
def validate_statistics(spark, sf):
    return round_doubles(P.validate_statistics(tbl(spark, sf, "lineitem"), EXPECTED_STATS))


@query("zscore_anomalies", """
with s as (select avg(l_quantity) mq, stddev_samp(l_quantity) sq, avg(l_extendedprice) me,
                  stddev_samp(l_extendedprice) se, avg(l_discount) md, stddev_samp(l_discount) sd
           from lineitem)
select 'l_quantity' column_name, count(*) filter (where abs(l_quantity - mq) / sq > 1.5) anomalies
from lineitem, s
union all select 'l_extendedprice', count(*) filter (where abs(l_extendedprice - me) / se > 1.5)
from lineitem, s
union all select 'l_discount', count(*) filter (where abs(l_discount - md) / sd > 1.5) from lineitem, s
""")
def zscore_anomalies(spark, sf):
    return P.anomaly_counts(tbl(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 1.5)


@query("invalid_values", """
select distinct o_orderpriority as value from orders
where o_orderpriority is not null and o_orderpriority not in ('1-URGENT', '2-HIGH')
""")
def invalid_values(spark, sf):
    return P.invalid_values(tbl(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


# Fields that every event document is declared to have.
DECLARED_FIELDS = ("k", "session_id")


@query("schema_diff", """
with actual as (select distinct event_type as dataset, unnest(json_keys(props)) column_name from events),
expected as (select distinct event_type as dataset, unnest(['k', 'session_id']) column_name from events)
select dataset, column_name from expected except select dataset, column_name from actual
""")
def schema_diff(spark, sf):
    """J6 over stored documents: declared fields that no document of an event type has."""
    e = tbl(spark, sf, "events")
    types = e.select(F.col("event_type").alias("dataset")).distinct()
    expected = types.withColumn("columns", F.array(*[F.lit(f) for f in DECLARED_FIELDS]))
    # distinct key lists first: a handful of rows per event type
    actual = e.select(F.col("event_type").alias("dataset"), F.json_object_keys("props").alias("columns")).distinct()
    return P.schema_diff_many(expected, actual).distinct()
