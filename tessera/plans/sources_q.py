"""Source / sink queries.

Round trips write into the shared checkpoint folder (``scratch_path``), never to
an executor-local temp dir.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import metrics as MT
from tessera.plans import mappings as M
from tessera.plans.common import joined, query, r6, round_doubles, tbl
from tessera.session import scratch_path
from tessera.sources import churn as CH
from tessera.sources import datasets as DS
from tessera.sources import files as FS
from tessera.sources.tables import table_path


@query("scan_csv", "select n_nationkey, n_name, n_regionkey from nation")
def scan_csv(spark, sf):
    path = scratch_path(spark, "nation-csv")
    tbl(spark, sf, "nation").write.option("header", True).csv(path)
    return FS.scan_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("scan_parquet", """
select l_orderkey, l_extendedprice, l_shipdate from lineitem
where l_shipdate >= timestamp '2000-01-01 00:00:00' and l_returnflag = 'R'
""")
def scan_parquet(spark, sf):
    li = FS.scan_parquet(spark, table_path(sf, "lineitem"))
    return li.where((F.col("l_shipdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
                    & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_extendedprice", "l_shipdate")


EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("scan_json_records", "select event_id, ts, user_id, event_type, value, props from events")
def scan_json_records(spark, sf):
    path = scratch_path(spark, "events-json")
    FS.write_json_records(tbl(spark, sf, "events"), path)
    return FS.scan_json_records(spark, path, EVENTS_DDL)


@query("scan_by_suffix", "select l_returnflag, count(*) n from lineitem group by l_returnflag")
def scan_by_suffix(spark, sf):
    df = FS.scan_by_suffix(spark, table_path(sf, "lineitem"))
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def _versioned_orders(spark, sf):
    root = scratch_path(spark, "datasets")
    meta_table = f"{root}/_dataset_metadata"
    o = tbl(spark, sf, "orders")
    DS.write_dataset_version(o.where(F.col("o_orderstatus") == "F"), root, "orders", "v20240101_000000",
                             tags={"stage": "partial"}, metadata_table=meta_table)
    meta = DS.write_dataset_version(o, root, "orders", "v20240102_000000", tags={"stage": "full"},
                                    source_type="parquet", source_path=table_path(sf, "orders"),
                                    metadata_table=meta_table)
    return root, meta_table, meta


@query("write_dataset_version", """
select 'orders' dataset_name, 'v20240102_000000' version, count(*) row_count, cast(6 as bigint) column_count,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' columns
from orders
""")
def write_dataset_version(spark, sf):
    _, _, meta = _versioned_orders(spark, sf)
    return meta.select("dataset_name", "version", "row_count", "column_count", joined("columns").alias("columns"))


@query("read_dataset_version", """
select o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total from orders group by o_orderstatus
""")
def read_dataset_version(spark, sf):
    root, meta_table, _ = _versioned_orders(spark, sf)
    latest = DS.read_dataset_version(spark, root, "orders", None, meta_table)
    return latest.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                                F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("dataset_checksum", """
select count(*) n, true same_after_round_trip, true same_in_another_order, true differs_without_a_row from lineitem
""")
def dataset_checksum(spark, sf):
    """The fingerprint of the stored copy and of the rows in another order is the same;
    without the rows of one order it is another."""
    li = tbl(spark, sf, "lineitem")
    path = scratch_path(spark, "checksum")
    li.write.parquet(path)
    first = li.agg(F.min("l_orderkey").alias("k"))
    sums = [DS.checksum(d).withColumnRenamed("checksum", name) for name, d in (
        ("a", li), ("b", spark.read.parquet(path)), ("c", li.repartition("l_partkey")),
        ("d", li.where(F.col("l_orderkey") != first.scalar())))]
    n = li.agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", *[(sums[0].scalar() == s.scalar() if same else sums[0].scalar() != s.scalar()).alias(name)
                           for s, same, name in ((sums[1], True, "same_after_round_trip"),
                                                 (sums[2], True, "same_in_another_order"),
                                                 (sums[3], False, "differs_without_a_row"))])


_PROFILE_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@query("incremental_profile", "\nunion all\n".join(
    f"""select '{c}' feature_name, count(*) row_count, count(*) - count({c}) null_count, """
    + (f"""round(avg({c}), 6) mean, round(stddev_samp({c}), 6) std, cast(min({c}) as double) min, cast(max({c}) as double) max"""
       if c in _PROFILE_NUMBERS else "null::double mean, null::double std, null::double min, null::double max")
    + ", true unique_close from orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def incremental_profile(spark, sf):
    """Orders written as one version a year and status, the profile of all versions merged from the stored ones;
    distinct counts lie within 4 % of the true ones (five standard errors)."""
    o = tbl(spark, sf, "orders")
    root, profiles = scratch_path(spark, "profiled"), scratch_path(spark, "profiles")
    year = F.year("o_orderdate")
    years = [r[0] for r in o.select(year.alias("y")).distinct().orderBy("y").collect()]  # a row a year
    for y in years:
        DS.write_dataset_version(o.where(year.eqNullSafe(F.lit(y))), root, "orders", f"v{y}", profile_table=profiles)
    exact = o.agg(F.array(*[F.struct(F.lit(c).alias("feature_name"), F.count_distinct(c).alias("exact")) for c in o.columns]).alias("a")).select(F.inline("a"))
    out = DS.dataset_profile(spark, profiles, "orders").join(exact, "feature_name")
    return out.select("feature_name", "row_count", "null_count", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max",
                      (F.abs(F.col("unique_estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.04 * F.col("exact"))).alias("unique_close"))


@query("dataset_size")
def dataset_size(spark, sf):
    return FS.dataset_size(spark.read.parquet(table_path(sf, "lineitem")))


@query("list_objects")
def list_objects(spark, sf):
    return FS.list_objects(spark, sf, "*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query("prediction_log_append", "with " + M.PREDICTIONS_SQL + """
select model_name, cast("timestamp" as date) log_date, count(*) n from predictions group by all
""")
def prediction_log_append(spark, sf):
    path = scratch_path(spark, "prediction-log")
    p = M.predictions(spark, sf)
    DS.prediction_log_append(p.where(F.col("status") == "success"), path)
    DS.prediction_log_append(p.where(F.col("status") == "error"), path)
    back = spark.read.parquet(path)
    return back.groupBy("model_name", "log_date").agg(F.count(F.lit(1)).alias("n"))


@query("metadata_append", "with " + M.FEATURE_REGISTRY_SQL + """
select feature_set_name, count(*) n_versions, cast(sum(len(words)) as bigint) n_features
from feature_registry group by feature_set_name
""")
def metadata_append(spark, sf):
    path = scratch_path(spark, "feature-registry")
    fr = M.feature_registry(spark, sf)
    # two registration batches (earlier and later registrations), then read back whole
    cut = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    DS.metadata_append(fr.where(F.col("created_at") < cut), path)
    DS.metadata_append(fr.where(F.col("created_at") >= cut), path)
    back = spark.read.parquet(path)
    return back.groupBy("feature_set_name").agg(F.count(F.lit(1)).alias("n_versions"),
                                                F.sum(F.size("features")).cast("bigint").alias("n_features"))


@query("metadata_latest_schema", "with " + M.FEATURE_REGISTRY_SQL + """
select feature_set_name, version, cast(len(words) as int) n_features from (
  select *, row_number() over (partition by feature_set_name order by created_at desc, version desc) rn
  from feature_registry) where rn = 1
""")
def metadata_latest_schema(spark, sf):
    """S7/W1 over an appended registry table: newest registration per feature set."""
    path = scratch_path(spark, "feature-registry")
    DS.metadata_append(M.feature_registry(spark, sf), path)
    back = spark.read.parquet(path)
    return C.latest_per_key(back, ["feature_set_name"], ["created_at", "version"]).select(
        "feature_set_name", "version", F.size("features").alias("n_features"))


@query("generate_churn")
def generate_churn(spark, sf):
    return CH.generate_churn(tbl(spark, sf, "customer"), "c_custkey", seed=42)


@query("dataset_summary")
def dataset_summary(spark, sf):
    ch = CH.generate_churn(tbl(spark, sf, "customer"), "c_custkey", seed=42)
    return round_doubles(MT.dataset_summary(ch, "churn", ["tenure", "monthly_charges", "total_charges"]))


CHURN_MAPPED_SQL = """
churn_mapped as (
  select o_orderkey,
         case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Month-to-month'
              when o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED') then 'One year' else 'Two year' end contract,
         case c_mktsegment when 'AUTOMOBILE' then 'Electronic check' when 'BUILDING' then 'Mailed check'
              when 'FURNITURE' then 'Bank transfer' else 'Credit card' end payment_method,
         case o_orderstatus when 'F' then 'DSL' when 'O' then 'Fiber optic' else 'No' end internet_service,
         cast(1 + o_orderkey % 72 as int) tenure,
         case when o_orderstatus = 'P' then 'No internet service' when o_orderkey % 3 = 0 then 'Yes' else 'No' end
           tech_support,
         case when o_orderstatus = 'P' then 'No internet service' when o_custkey % 4 = 0 then 'Yes' else 'No' end
           online_security,
         cast(c_nationkey % 7 = 0 as int) senior_citizen,
         20 + o_totalprice % 100 monthly_charges
  from orders join customer on o_custkey = c_custkey)
"""


def _churn_mapped(spark, sf):
    o, c = tbl(spark, sf, "orders"), tbl(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    st = F.col("o_orderstatus")
    return j.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Month-to-month")
        .when(F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED"), "One year").otherwise("Two year")
        .alias("contract"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Electronic check")
        .when(F.col("c_mktsegment") == "BUILDING", "Mailed check")
        .when(F.col("c_mktsegment") == "FURNITURE", "Bank transfer").otherwise("Credit card").alias("payment_method"),
        F.when(st == "F", "DSL").when(st == "O", "Fiber optic").otherwise("No").alias("internet_service"),
        (1 + F.col("o_orderkey") % 72).cast("int").alias("tenure"),
        F.when(st == "P", "No internet service").when(F.col("o_orderkey") % 3 == 0, "Yes").otherwise("No")
        .alias("tech_support"),
        F.when(st == "P", "No internet service").when(F.col("o_custkey") % 4 == 0, "Yes").otherwise("No")
        .alias("online_security"),
        (F.col("c_nationkey") % 7 == 0).cast("int").alias("senior_citizen"),
        (20 + F.col("o_totalprice") % 100).alias("monthly_charges"))


@query("churn_rule_score", "with " + CHURN_MAPPED_SQL + """
select o_orderkey, round(cast(least(greatest(
         (case when contract = 'Month-to-month' then 0.25 else 0.0 end)
         + (case when payment_method = 'Electronic check' then 0.15 else 0.0 end)
         + (case when internet_service = 'Fiber optic' then 0.10 else 0.0 end)
         - (case when tenure > 24 then 0.15 else 0.0 end)
         - (case when tenure > 48 then 0.10 else 0.0 end)
         - (case when tech_support = 'Yes' then 0.10 else 0.0 end)
         - (case when online_security = 'Yes' then 0.08 else 0.0 end)
         + senior_citizen * 0.05
         + (case when monthly_charges > 80 then 0.10 else 0.0 end), 0.05), 0.95) as double), 6) churn_probability
from churn_mapped
""")
def churn_rule_score(spark, sf):
    m = _churn_mapped(spark, sf)
    p = CH.churn_rule_score(F.col("contract"), F.col("payment_method"), F.col("internet_service"),
                            F.col("tenure"), F.col("tech_support"), F.col("online_security"),
                            F.col("senior_citizen"), F.col("monthly_charges"))
    return m.select("o_orderkey", F.round(p, 6).alias("churn_probability"))
