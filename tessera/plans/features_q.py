"""Feature transform queries (F1–F9, F11, W5, P7, P8, J8 key)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import transforms as X
from tessera.operators import features as FE
from tessera.plans.common import joined, query, r6, round_doubles, tbl


@query("derive_log", """
select l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) as log_price,
       round(case when c_acctbal > -1 then ln(1 + c_acctbal) end, 6) as log_acctbal
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
""")
def derive_log(spark, sf):
    li, o, c = tbl(spark, sf, "lineitem"), tbl(spark, sf, "orders"), tbl(spark, sf, "customer")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.select("l_orderkey", "l_linenumber", r6(X.log1p(F.col("l_extendedprice"))).alias("log_price"),
                    r6(X.log1p(F.col("c_acctbal"))).alias("log_acctbal"))


@query("derive_sqrt", """
select c_custkey, round(case when c_acctbal >= 0 then sqrt(c_acctbal) end, 6) as sqrt_acctbal from customer
""")
def derive_sqrt(spark, sf):
    c = tbl(spark, sf, "customer")
    return c.select("c_custkey", r6(X.sqrt(F.col("c_acctbal"))).alias("sqrt_acctbal"))


@query("derive_square", """
select l_orderkey, l_linenumber, round(l_quantity * l_quantity, 6) as sq_quantity,
       cast(l_linenumber as double) * l_linenumber as sq_linenumber from lineitem
""")
def derive_square(spark, sf):
    li = tbl(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(X.square(F.col("l_quantity"))).alias("sq_quantity"),
                     X.square(F.col("l_linenumber")).alias("sq_linenumber"))


BIN_EDGES_SQL = """
e as (select list_sort(list_distinct(list_transform(
        quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]),
        lambda t: round(t, 9)))) as edges from lineitem)
"""


@query("derive_binning", "with " + BIN_EDGES_SQL + """,
b as (select l_extendedprice x,
             case when len(edges) >= 2 then len(list_filter(edges[2:len(edges)-1], lambda t: t < l_extendedprice)) end
               as bin
      from lineitem, e)
select cast(bin as int) as bin, count(*) as n, round(min(x), 6) as lo, round(max(x), 6) as hi from b group by bin
""")
def derive_binning(spark, sf):
    li = tbl(spark, sf, "lineitem")
    b = FE.quantile_bin(li, "l_extendedprice", "bin", q=10)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.min("l_extendedprice")).alias("lo"),
                                r6(F.max("l_extendedprice")).alias("hi"))


@query("scale_standard", """
with t as (select c_custkey, case when c_acctbal >= 0 then c_acctbal end as x from customer),
s as (select avg(x) m, stddev_pop(x) sd from t)
select c_custkey, round(coalesce((coalesce(x, m) - m) / nullif(sd, 0), 0), 6) as z from t, s
""")
def scale_standard(spark, sf):
    c = tbl(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
                                          .alias("x"))
    return FE.standard_scale(c, "x", "z").select("c_custkey", r6("z").alias("z"))


@query("encode_onehot", """
with t as (select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'missing') as v from customer),
cats as (select list_sort(list(distinct v)) cs from t)
select c_custkey, array_to_string(list_transform(cs, lambda c: case when c = v then 1 else 0 end), ',') as vec
from t, cats
""")
def encode_onehot(spark, sf):
    c = tbl(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("seg"))
    return FE.onehot_encode(c, "seg", "vec").select("c_custkey", joined("vec").alias("vec"))


@query("encode_onehot_sparse", """
with v as (select distinct coalesce(cast(o_custkey as varchar), 'missing') v from orders),
c as (select v, row_number() over (order by v) - 1 as code, count(*) over () as k from v)
select o.o_orderkey, cast(c.k as int) "size", cast(c.code as int) "index"
from orders o join c on c.v = coalesce(cast(o.o_custkey as varchar), 'missing')
""")
def encode_onehot_sparse(spark, sf):
    """F6 over as many categories as there are customers."""
    out = FE.onehot_sparse(tbl(spark, sf, "orders"), "o_custkey", "hot")
    return out.select("o_orderkey", "hot.size", F.col("hot.indices")[0].alias("index"))


@query("label_encode", """
with codes as (select v, cast(row_number() over (order by v) - 1 as int) code
               from (select distinct coalesce(o_orderpriority, 'missing') v from orders))
select o_orderkey, code from orders join codes on coalesce(o_orderpriority, 'missing') = v
""")
def label_encode(spark, sf):
    o = tbl(spark, sf, "orders")
    return FE.label_encode(o, "o_orderpriority", "code").select("o_orderkey", "code")


@query("datetime_parts", """
select o_orderkey, year(o_orderdate) as d_year, month(o_orderdate) as d_month, day(o_orderdate) as d_day,
       isodow(o_orderdate) - 1 as d_dayofweek, hour(o_orderdate) as d_hour
from orders
""")
def datetime_parts(spark, sf):
    o = tbl(spark, sf, "orders")
    parts = X.datetime_parts(F.col("o_orderdate"), "d", X.DATETIME_COMPONENTS)
    return o.select("o_orderkey", *[v.alias(k) for k, v in parts.items()])


@query("impute_constant", """
select c_custkey, coalesce(case when c_acctbal >= 0 then c_acctbal end, 0.0) as c_acctbal,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'missing') as c_mktsegment from customer
""")
def impute_constant(spark, sf):
    c = tbl(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"))
    return FE.impute_constant(FE.impute_constant(c, 0.0, ["c_acctbal"]), "missing", ["c_mktsegment"])


@query("impute_mean", """
with t as (select c_custkey, case when c_acctbal >= 0 then c_acctbal end as x from customer)
select c_custkey, round(coalesce(x, (select avg(x) from t)), 6) as x from t
""")
def impute_mean(spark, sf):
    c = tbl(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
                                          .alias("x"))
    return FE.impute_mean(c, ["x"]).select("c_custkey", r6("x").alias("x"))


FEATURE_SET = [
    FE.FeatureDef("price_bin", "derived", "log_price", "binning", {"bins": "5"}, ["log_price"]),
    FE.FeatureDef("log_price", "derived", "l_extendedprice", "log"),
    FE.FeatureDef("qty_sq", "derived", "l_quantity", "square"),
    FE.FeatureDef("tax_sqrt", "derived", "l_tax", "sqrt"),
    FE.FeatureDef("disc_z", "numeric", "l_discount", "standard"),
    FE.FeatureDef("flag_code", "categorical", "l_returnflag", "label"),
    FE.FeatureDef("status_vec", "categorical", "l_linestatus", "onehot"),
    FE.FeatureDef("ship", "datetime", "l_shipdate", None, {"components": "year,month,dayofweek"}),
    FE.FeatureDef("ignored", "derived", "l_quantity", "cube"),
]


@query("engineer_features", """
with e as (select list_sort(list_distinct(list_transform(
             quantile_cont(ln(1 + l_extendedprice), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda t: round(t, 9)))) edges,
                  avg(l_discount) dm, stddev_pop(l_discount) ds
           from lineitem),
codes as (select v, row_number() over (order by v) - 1 code from (select distinct l_returnflag v from lineitem))
select l_orderkey, l_linenumber,
       round(ln(1 + l_extendedprice), 6) as log_price,
       cast(len(list_filter(edges[2:len(edges)-1], lambda t: t < ln(1 + l_extendedprice))) as int) as price_bin,
       round(l_quantity * l_quantity, 6) as qty_sq,
       round(sqrt(l_tax), 6) as tax_sqrt,
       round(coalesce((l_discount - dm) / nullif(ds, 0), 0), 6) as disc_z,
       cast(code as int) as flag_code,
       case when l_linestatus = 'F' then '1,0' else '0,1' end as status_vec,
       year(l_shipdate) as ship_year, month(l_shipdate) as ship_month, isodow(l_shipdate) - 1 as ship_dayofweek,
       cast(10 as bigint) as n_added
from lineitem, e, codes where codes.v = l_returnflag
""")
def engineer_features(spark, sf):
    li = tbl(spark, sf, "lineitem")
    out, added = FE.engineer_features(li, FEATURE_SET)
    return round_doubles(out.select("l_orderkey", "l_linenumber", *added)
                         .withColumn("status_vec", joined("status_vec"))
                         .withColumn("n_added", F.lit(len(added)).cast("bigint")))


@query("custom_transformer", """
with st as (select ln(1 + l_extendedprice) lp, l_quantity q from lineitem),
m as (select avg(lp) ml, stddev_pop(lp) sl, avg(q) mq, stddev_pop(q) sq from st)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((ln(1 + l_extendedprice) - ml) / sl, 6) price_z,
       round((l_quantity - mq) / sq, 6) quantity_z
from lineitem, m
""")
def custom_transformer(spark, sf):
    """A user's transformer (log first, then the base class's standard scaling) and the base
    class itself, fitted and applied in one ML pipeline."""
    from pyspark.ml import Pipeline

    class LogScaler(FE.FeatureTransformer):
        def _fit(self, dataset):
            inner = FE.FeatureTransformer("__log", self.getOutputCol(), "standard")
            fitted = inner.fit(dataset.select(F.log1p(F.col(self.getInputCol())).alias("__log")))
            return _Logged(self.getInputCol(), fitted)

    class _Logged(FE.FittedColumnTransformer):
        def __init__(self, col, inner):
            super().__init__(col, inner.getOutputCol(), "standard", inner.state)
            self.inner = inner

        def _transform(self, dataset):
            return self.inner.transform(dataset.withColumn("__log", F.log1p(F.col(self.getInputCol())))).drop("__log")

    li = tbl(spark, sf, "lineitem")
    model = Pipeline(stages=[LogScaler("l_extendedprice", "price_z"),
                             FE.FeatureTransformer("l_quantity", "quantity_z")]).fit(li)
    return model.transform(li).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                      F.round("price_z", 6).alias("price_z"), F.round("quantity_z", 6).alias("quantity_z"))


@query("features_hash", """
select event_id, md5('{"k":"' || (props->>'k') || '"}') as features_hash from events
""")
def features_hash(spark, sf):
    e = tbl(spark, sf, "events")
    return e.select("event_id", X.features_hash(F.col("props")).alias("features_hash"))


@query("score_distinct", """
select count(*) as requests, count(distinct md5('{"k":"' || (props->>'k') || '"}')) as distinct_documents,
       cast(0 as bigint) as unscored, cast(0 as bigint) as differing
from events
""")
def score_distinct(spark, sf):
    """A fitted model scores every distinct features document once, and each request gets
    its document's prediction -- the same as scoring all requests."""
    from pyspark.ml import Pipeline

    from tessera.operators import ml as ML
    e = tbl(spark, sf, "events").select(
        "event_id", X.features_hash(F.col("props")).alias("h"), F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("event_type") == "purchase").cast("double").alias("label"))
    model = Pipeline(stages=[*ML.feature_pipeline(["k"]), ML.trainers()["logistic_regression"].build({"max_iter": 20})]).fit(e)
    got = ML.score_distinct(model, e, "h", "event_id")
    want = model.transform(e).select("event_id", F.col("prediction").alias("want"))
    return got.join(want, "event_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("h").alias("distinct_documents"),
        F.count_if(F.col("prediction").isNull()).alias("unscored"),
        F.count_if(F.col("prediction") != F.col("want")).alias("differing"))


@query("ids_and_hashes", """
select event_id, 'pred-' || substr(sha256(cast(event_id as varchar) || '|' || cast(user_id as varchar)), 1, 12) pred_id,
       md5('{"k":"' || (props->>'k') || '"}') features_hash,
       strftime(ts, 'v%Y%m%d_%H%M%S') version,
       cast(row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as int) batch_index
from events
""")
def ids_and_hashes(spark, sf):
    """deterministic prediction ids, feature-document hashes, version stamps and the
    index of a request inside its batch (here: a user's requests of one day).

    The batch index is a distributed rank (prefix sum), so a user holding a third of
    all requests is not sorted in one task."""
    from tessera.operators.ranks import prefix_sums
    e = tbl(spark, sf, "events").withColumn("day", F.to_date("ts")).withColumn("__one", F.lit(1.0))
    ranked = prefix_sums(e, ["user_id", "day"], ["ts", "event_id"], ["__one"])
    return ranked.select("event_id", X.short_id("pred", F.col("event_id"), F.col("user_id")).alias("pred_id"),
                         X.features_hash(F.col("props")).alias("features_hash"),
                         X.version_stamp(F.col("ts")).alias("version"),
                         (F.col("cum___one") - 1).cast("int").alias("batch_index"))
