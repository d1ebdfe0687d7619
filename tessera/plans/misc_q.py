"""Projection, row-validation, set-operation and scalar-function queries
(P1, P2, P9–P11, U1, U2, U4, F12–F14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rows as R
from tessera.plans import mappings as M
from tessera.plans.common import query, r6, tbl


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


AS_OF = "2024-01-30 12:00:00"


@query("align_columns", "select l_quantity, l_discount, 0 as tenure, l_tax from lineitem")
def align_columns(spark, sf):
    return R.align_columns(tbl(spark, sf, "lineitem"), ["l_quantity", "l_discount", "tenure", "l_tax"])


@query("select_features", "select l_orderkey, l_quantity, l_extendedprice from lineitem")
def select_features(spark, sf):
    return R.select_features(tbl(spark, sf, "lineitem"), ["l_orderkey", "l_quantity", "l_extendedprice"])


ORDER_RULES = [
    R.range_rule("o_totalprice", 0.0, 400000.0),
    R.enum_rule("o_orderstatus", ["F", "O"]),
    R.regex_rule("o_orderpriority", "^[1-3]-.*$"),
    R.not_null_rule("o_clerk_note"),
]


@query("quarantine_rows", """
select o_orderkey, reasons = '' as valid, reasons from (
  select o_orderkey, concat_ws(';',
      case when not coalesce(o_totalprice is not null and o_totalprice >= 0.0 and o_totalprice <= 400000.0, false)
           then 'o_totalprice out of range' end,
      case when not coalesce(o_orderstatus in ('F', 'O'), false) then 'o_orderstatus not allowed' end,
      case when not coalesce(regexp_matches(o_orderpriority, '^[1-3]-.*$'), false)
           then 'o_orderpriority bad format' end,
      case when o_orderpriority = '5-LOW' then 'o_clerk_note is null' end) reasons
  from orders)
""")
def quarantine_rows(spark, sf):
    o = tbl(spark, sf, "orders").withColumn(
        "o_clerk_note", F.when(F.col("o_orderpriority") != "5-LOW", F.lit("ok")))
    valid, rejected = R.quarantine_rows(o, ORDER_RULES)
    return (valid.select("o_orderkey", F.lit(True).alias("valid"), F.lit("").alias("reasons"))
            .unionByName(rejected.select("o_orderkey", F.lit(False).alias("valid"),
                                         F.array_join("reasons", ";").alias("reasons"))))


@query("validate_input", """
select event_id, concat_ws('; ',
    case when not list_contains(json_keys(props), 'score') then 'Missing required features: score' end,
    case when json_type(props, '$.k') not in ('BIGINT', 'UBIGINT') then 'Feature ''k'' should be integer' end)
  as errors
from events
""")
def validate_input(spark, sf):
    e = tbl(spark, sf, "events")
    v = R.validate_input(e, "props", ["k", "score"], {"k": "integer"})
    return v.select("event_id", F.array_join("errors", "; ").alias("errors"))


@query("validate_output", "with " + M.PREDICTIONS_SQL + """
select prediction_id, concat_ws('; ',
    case when prediction is null then 'Missing ''prediction'' field in output' end,
    case when p < 0 or p > 1 then 'Probability ' || cast(p as varchar) || ' not in valid range [0, 1]' end) errors
from (select prediction_id, case when status = 'error' then null else prediction end prediction,
             probability * 2 - 0.5 p from predictions)
""")
def validate_output(spark, sf):
    p = M.predictions(spark, sf).select(
        "prediction_id", F.when(F.col("status") == "error", F.lit(None)).otherwise(F.col("prediction"))
        .alias("prediction"), (F.col("probability") * 2 - 0.5).alias("p"))
    v = R.validate_output(p, "prediction", "p")
    return v.select("prediction_id", F.array_join("errors", "; ").alias("errors"))


@query("concat_train_val", """
select split, l_returnflag, count(*) n from (
  select 'train' split, * from lineitem where l_shipdate < timestamp '1997-01-01 00:00:00'
  union all
  select 'validation', * from lineitem where l_shipdate >= timestamp '1997-01-01 00:00:00'
                                        and l_shipdate < timestamp '1998-06-01 00:00:00')
group by all
""")
def concat_train_val(spark, sf):
    li = tbl(spark, sf, "lineitem")
    d = F.col("l_shipdate")
    train = li.where(d < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).withColumn("split", F.lit("train"))
    val = li.where((d >= F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
                   & (d < F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))).withColumn("split",
                                                                                          F.lit("validation"))
    return train.unionByName(val).groupBy("split", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("category_union", "with " + M.LINEITEM_SCORED_SQL + """
select actual as category from lineitem_scored union select predicted from lineitem_scored
""")
def category_union(spark, sf):
    s = M.lineitem_scored(spark, sf)
    return s.select(F.col("actual").alias("category")).union(s.select("predicted")).distinct()


@query("missing_keys", """
select c_custkey from customer
where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')
""")
def missing_keys(spark, sf):
    """Customers with no urgent order (anti join by key)."""
    c, o = tbl(spark, sf, "customer"), tbl(spark, sf, "orders")
    urgent = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return R.missing_keys(c.select("c_custkey"), urgent, "c_custkey")


@query("unexpected_values", """
select p_partkey from part except select l_partkey from lineitem where l_quantity > 40
""")
def unexpected_values(spark, sf):
    """Parts never sold in quantities above 40 (distinct set difference)."""
    p, li = tbl(spark, sf, "part"), tbl(spark, sf, "lineitem")
    big = li.where(F.col("l_quantity") > 40).select(F.col("l_partkey").alias("p_partkey"))
    return R.difference(p.select("p_partkey"), big)


@query("string_functions", """
select p_partkey, contains(lower(p_name), 'ring') has_ring, regexp_matches(p_name, '^(small|red)') prefix_match,
       cast(p_size as varchar) size_text, to_json({'p_partkey': p_partkey, 'p_brand': p_brand}) doc,
       json_extract_string(to_json({'p_partkey': p_partkey, 'p_brand': p_brand}), '$.p_brand') brand_back
from part
""")
def string_functions(spark, sf):
    p = tbl(spark, sf, "part")
    doc = F.to_json(F.struct("p_partkey", "p_brand"))
    return p.select("p_partkey", F.lower("p_name").contains("ring").alias("has_ring"),
                    F.col("p_name").rlike("^(small|red)").alias("prefix_match"),
                    F.col("p_size").cast("string").alias("size_text"), doc.alias("doc"),
                    F.from_json(doc, "p_partkey bigint, p_brand string")["p_brand"].alias("brand_back"))


@query("url_rules", """
select page_id, regexp_matches(url, '^https://') secure, regexp_extract(url, '^https?://([^/?#]+)', 1) host,
       regexp_matches(url, '^https?://[^/]+/(en|fr)/') en_or_fr
from pages
""")
def url_rules(spark, sf):
    pg = tbl(spark, sf, "pages")
    u = F.col("url")
    return pg.select("page_id", u.rlike("^https://").alias("secure"),
                     F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"),
                     u.rlike("^https?://[^/]+/(en|fr)/").alias("en_or_fr"))


@query("time_functions", f"""
select event_id, epoch_us(ts) // 1000 ms, make_timestamp(epoch_us(ts) // 1000 * 1000) from_ms,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') iso, strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') parsed,
       floor((epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 86400000000) < 1 fresh
from events
""")
def time_functions(spark, sf):
    e = tbl(spark, sf, "events")
    ms = F.timestamp_diff("MILLISECOND", _epoch(), F.col("ts"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    age_us = F.timestamp_diff("MICROSECOND", F.col("ts"), F.lit(AS_OF).cast("timestamp_ntz"))
    return e.select("event_id", ms.alias("ms"), F.timestamp_add("MILLISECOND", ms, _epoch()).alias("from_ms"),
                    iso.alias("iso"), F.to_timestamp_ntz(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("parsed"),
                    (F.floor(age_us / 86_400_000_000) < 1).alias("fresh"))


@query("math_functions", """
select vec_id, round(list_max(list_transform(embedding, lambda x: abs(x::double))), 6) max_abs,
       round(list_sum(list_transform(embedding, lambda x: least(greatest(x::double, -0.1), 0.1))), 6) clipped_sum,
       round(embedding[4]::double, 2) third_rounded,
       round(map_from_entries(list_transform(range(1, 65), lambda i: {'k': cast(i - 1 as varchar), 'v': embedding[i]::double}))['7'], 6) by_name
from embeddings
""")
def math_functions(spark, sf):
    emb = tbl(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    names = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("string"))
    return emb.select("vec_id", r6(F.array_max(F.transform(v, lambda x: F.abs(x)))).alias("max_abs"),
                      r6(F.aggregate(F.transform(v, lambda x: F.least(F.greatest(x, F.lit(-0.1)), F.lit(0.1))),
                                     F.lit(0.0), lambda a, b: a + b)).alias("clipped_sum"),
                      F.round(F.element_at(v, 4), 2).alias("third_rounded"),
                      r6(F.element_at(F.map_from_arrays(names, v), F.lit("7"))).alias("by_name"))


def _pii_sql(table: str, key: str) -> str:
    from tessera.functions.text import PII_PATTERNS
    cur, counts = "text", []
    for kind, pattern, token in PII_PATTERNS:
        counts.append(f"cast(len(regexp_extract_all({cur}, '{pattern}')) as bigint) n_{kind}")
        cur = f"regexp_replace({cur}, '{pattern}', '{token}', 'g')"
    return f"select {key}, {', '.join(counts)}, md5({cur}) masked_md5, length({cur}) masked_chars from {table}"


@query("pii_masking", _pii_sql("documents", "doc_id"))
def pii_masking(spark, sf):
    """Detect and mask e-mails, card-like numbers and IPv4 addresses in every document."""
    from tessera.functions.text import mask_pii, pii_counts
    d = tbl(spark, sf, "documents")
    masked = mask_pii(F.col("text"))
    return d.select("doc_id", *[v.alias(k) for k, v in pii_counts(F.col("text")).items()],
                    F.md5(masked).alias("masked_md5"), F.length(masked).cast("bigint").alias("masked_chars"))


@query("pii_masking_conversations", _pii_sql("conversations", "conv_id, turn"))
def pii_masking_conversations(spark, sf):
    """The same masking over every conversation turn."""
    from tessera.functions.text import mask_pii, pii_counts
    c = tbl(spark, sf, "conversations")
    masked = mask_pii(F.col("text"))
    return c.select("conv_id", "turn", *[v.alias(k) for k, v in pii_counts(F.col("text")).items()],
                    F.md5(masked).alias("masked_md5"), F.length(masked).cast("bigint").alias("masked_chars"))
