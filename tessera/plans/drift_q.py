"""Drift queries (U3, J5, W7, D1–D8, P3) and the generator of their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import chi2_sf_sql, ks_exact_sql, ks_pvalue_sql
from tessera.operators import drift as D
from tessera.plans import mappings as M
from tessera.plans.common import query, round_doubles, tbl

SPLIT_DATE = "1998-06-01 00:00:00"
EVENTS_SPLIT = "2024-01-15 00:00:00"
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CAT = ["l_returnflag", "l_linestatus"]


def _sides(df, ts_col, split):
    before = F.col(ts_col) < F.lit(split).cast("timestamp_ntz")
    return df.where(before), df.where(~before)


def _union(selects):
    return "\n  union all ".join(selects)


def drift_sql(src: str, numeric: list[str], categorical: list[str], psi: bool = True, bins: int = 10,
              threshold: float = 0.1, final: str | None = None) -> str:
    """DuckDB SQL computing the same per-feature drift table as ``operators.drift``.

    ``src`` defines a CTE ``src`` with the columns and a ``side`` column.
    """
    ctes = [src]
    tests = []
    if numeric:
        ctes.append("nl as (select * from (\n  " + _union(
            [f"select side, '{c}' feature, cast({c} as double) v from src" for c in numeric]) + ") where v is not null)")
        ctes.append("""ncnt as (select feature, v, sum(case when side = 'reference' then 1.0 else 0.0 end) n_ref,
                  sum(case when side = 'current' then 1.0 else 0.0 end) n_cur from nl group by feature, v)""")
        ctes.append("""ncum as (select *, sum(n_ref) over w cr, sum(n_cur) over w cc,
                  sum(n_ref) over (partition by feature) big_n, sum(n_cur) over (partition by feature) big_m
           from ncnt window w as (partition by feature order by v rows between unbounded preceding and current row))""")
        ctes.append("""ks as (select feature, 'ks' test,
                max(abs(coalesce(cr / nullif(big_n, 0), 0) - coalesce(cc / nullif(big_m, 0), 0))) statistic,
                any_value(big_n) n_ref, any_value(big_m) n_cur from ncum group by feature)""")
        tests.append(f"select feature, test, statistic, {ks_pvalue_sql('statistic', 'n_ref', 'n_cur')} p_value, "
                     "n_ref, n_cur from ks")
    if categorical:
        ctes.append("cl as (select * from (\n  " + _union(
            [f"select side, '{c}' feature, cast({c} as varchar) v from src" for c in categorical]) +
            ") where v is not null)")
        ctes.append("""ccnt as (select feature, v, sum(case when side = 'reference' then 1.0 else 0.0 end) n_ref,
                  sum(case when side = 'current' then 1.0 else 0.0 end) n_cur from cl group by feature, v)""")
        ctes.append("""ctot as (select feature, sum(n_ref) big_n, sum(n_cur) big_m, count(*) k from ccnt group by feature)""")
        ctes.append("""chi as (select feature, big_n, big_m, k,
                 sum(case when n_ref * (big_m / big_n) > 0
                          then (n_cur - n_ref * (big_m / big_n)) ^ 2 / (n_ref * (big_m / big_n))
                          when n_cur > 0 then 'inf'::double else 0.0 end) statistic
          from ccnt join ctot using (feature) group by all)""")
        tests.append(f"select feature, 'chi_square' test, statistic, {chi2_sf_sql('statistic', 'k - 1')} p_value, "
                     "big_n n_ref, big_m n_cur from chi")
    ctes.append("tests as (" + " union all ".join(tests) + ")")
    if psi:
        binned = []
        if numeric:
            probs = ", ".join(str(i / bins) for i in range(bins + 1))
            ctes.append(f"""edges as (select feature, list_sort(list_distinct(quantile_cont(v, [{probs}]))) e
                        from nl where side = 'reference' group by feature)""")
            binned.append("""select nl.feature, side, cast(len(list_filter(e[2:len(e)-1], lambda x: x < v)) as varchar) bin
                   from nl join edges using (feature)""")
        if categorical:
            binned.append("select feature, side, v bin from cl")
        ctes.append("binned as (" + " union all ".join(binned) + ")")
        ctes.append("""pc as (select feature, bin, sum(case when side = 'reference' then 1.0 else 0.0 end) r,
                 sum(case when side = 'current' then 1.0 else 0.0 end) c from binned group by all)""")
        ctes.append("""pt as (select feature, sum(r) big_r, sum(c) big_c from pc group by feature)""")
        ctes.append("""psi as (select feature, sum((greatest(c / big_c, 0.0001) - greatest(r / big_r, 0.0001))
                              * ln(greatest(c / big_c, 0.0001) / greatest(r / big_r, 0.0001))) psi,
                  count(*) n_bins from pc join pt using (feature) group by feature)""")
    if final is not None:
        return "with " + ",\n".join(ctes) + "\n" + final
    sel = ("select t.feature, t.test, round(t.statistic, 6) statistic, round(t.p_value, 6) p_value, "
           "cast(t.n_ref as bigint) n_ref, cast(t.n_cur as bigint) n_cur, round(1 - t.p_value, 6) drift_score, "
           f"coalesce(t.p_value < {threshold}, false) drift_detected")
    if psi:
        sel += ", round(psi.psi, 6) psi, psi.n_bins from tests t left join psi using (feature)"
    else:
        sel += " from tests t"
    return "with " + ",\n".join(ctes) + "\n" + sel


LI_SRC = f"""src as (select *, case when l_shipdate < timestamp '{SPLIT_DATE}' then 'reference' else 'current' end side
        from lineitem)"""


def _li_sides(spark, sf):
    return _sides(tbl(spark, sf, "lineitem"), "l_shipdate", SPLIT_DATE)


@query("data_drift", drift_sql(LI_SRC, LI_NUM, LI_CAT))
def data_drift(spark, sf):
    ref, cur = _li_sides(spark, sf)
    return round_doubles(D.data_drift(ref, cur, LI_NUM + LI_CAT, method="asymptotic"))


@query("drift_summary", drift_sql(LI_SRC, LI_NUM, LI_CAT, psi=False, final="""
, per as (select feature f, coalesce(p_value < 0.1, false) drift_detected from tests)
select count(*) features_analyzed, count(*) filter (where drift_detected) features_drifted,
       round(count(*) filter (where drift_detected) / count(*), 6) drift_score,
       count(*) filter (where drift_detected) / count(*) > 0.1 drift_detected, 0.1 threshold,
       coalesce(string_agg(f, ',' order by f) filter (where drift_detected), '') drifted_features
from per
"""))
def drift_summary(spark, sf):
    ref, cur = _li_sides(spark, sf)
    s = D.drift_summary(D.data_drift(ref, cur, LI_NUM + LI_CAT, with_psi=False, method="asymptotic"))
    return round_doubles(s.select("features_analyzed", "features_drifted", "drift_score", "drift_detected",
                                  "threshold", F.array_join("drifted_features", ",").alias("drifted_features")))


EV_SRC = f"""src as (select *, cast(json_extract_string(props, '$.k') as int) as k,
               case when ts < timestamp '{EVENTS_SPLIT}' then 'reference' else 'current' end side from events)"""


def _events_sides(spark, sf):
    e = tbl(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return _sides(e, "ts", EVENTS_SPLIT)


@query("ks_test", drift_sql(EV_SRC, ["value", "user_id"], [], psi=False))
def ks_test(spark, sf):
    ref, cur = _events_sides(spark, sf)
    return round_doubles(D.ks_test(D.stack_sides(ref, cur, ["value", "user_id"]), ["value", "user_id"], method="asymptotic"))


SMALL_SQL = f"""
with recursive src as (select l_suppkey, l_quantity v, l_shipdate < timestamp '{SPLIT_DATE}' as old from lineitem where l_quantity is not null),
cnt as (select l_suppkey, v, count(*) filter (where old) a, count(*) filter (where not old) b from src group by all),
cum as (select *, sum(a) over w ca, sum(b) over w cb, sum(a) over (partition by l_suppkey) n, sum(b) over (partition by l_suppkey) m
        from cnt window w as (partition by l_suppkey order by v)),
d as (select l_suppkey, max(abs(coalesce(ca / nullif(n, 0), 0) - coalesce(cb / nullif(m, 0), 0))) statistic, any_value(n) n_ref, any_value(m) n_cur
      from cum group by l_suppkey),
{ks_exact_sql('d', 'l_suppkey')}
select d.l_suppkey, round(d.statistic, 6) statistic, round(coalesce(exact.p_value, case when n_ref > 0 and n_cur > 0 then 1.0 end), 6) p_value,
       cast(n_ref as bigint) n_ref, cast(n_cur as bigint) n_cur
from d left join exact using (l_suppkey)
"""


@query("ks_small_samples", SMALL_SQL)
def ks_small_samples(spark, sf):
    """D2 with exact p-values: each supplier's quantities, before against after the split."""
    ref, cur = _li_sides(spark, sf)
    out = D.data_drift(ref, cur, ["l_quantity"], with_psi=False, keys=["l_suppkey"], method="exact")
    return round_doubles(out.select("l_suppkey", "statistic", "p_value", "n_ref", "n_cur"))


@query("chi_square_test", drift_sql(EV_SRC, [], ["event_type"], psi=False))
def chi_square_test(spark, sf):
    ref, cur = _events_sides(spark, sf)
    return round_doubles(D.chi_square_test(D.stack_sides(ref, cur, ["event_type"]), ["event_type"]))


# a positive case: current latency scaled ×1.3 must drift
EV_SHIFT_SRC = f"""src as (select case when ts < timestamp '{EVENTS_SPLIT}' then value else value * 1.3 end as value,
                     event_type, case when ts < timestamp '{EVENTS_SPLIT}' then 'reference' else 'current' end side
              from events)"""


@query("psi", drift_sql(EV_SHIFT_SRC, ["value"], ["event_type"],
                       final="select feature, round(psi, 6) psi, n_bins from psi"))
def psi(spark, sf):
    ref, cur = _events_sides(spark, sf)
    cur = cur.withColumn("value", F.col("value") * 1.3)
    st = D.stack_sides(ref, cur, ["value", "event_type"])
    return round_doubles(D.psi(st, ["value"], ["event_type"]))


PRED_SRC = "src as (select *, case when \"timestamp\" < timestamp '" + EVENTS_SPLIT + \
    "' then 'reference' else 'current' end side from predictions)"


@query("prediction_drift", "with " + M.PREDICTIONS_SQL.strip() + ",\n" + drift_sql(
    PRED_SRC, ["probability"], [], psi=False)[len("with "):])
def prediction_drift(spark, sf):
    p = M.predictions(spark, sf)
    ref, cur = _sides(p, "timestamp", EVENTS_SPLIT)
    return round_doubles(D.prediction_drift(ref, cur, "probability", method="asymptotic"))


@query("concept_drift", drift_sql(LI_SRC, [], ["l_returnflag"], psi=False))
def concept_drift(spark, sf):
    ref, cur = _li_sides(spark, sf)
    return round_doubles(D.concept_drift(ref, cur, "l_returnflag", method="asymptotic"))


@query("feature_drift", drift_sql(EV_SRC, ["k", "value"], [], psi=True))
def feature_drift(spark, sf):
    """Per-feature drift of the flattened features document (P3 + D1 rows)."""
    e = D.flatten_features(tbl(spark, sf, "events"), "props", ["k"], "int")
    ref, cur = _sides(e, "ts", EVENTS_SPLIT)
    return round_doubles(D.data_drift(ref, cur, ["k", "value"], method="asymptotic"))


@query("ecdf", "with " + EV_SRC + """,
c as (select v, sum(case when side = 'reference' then 1.0 else 0.0 end) n_ref,
             sum(case when side = 'current' then 1.0 else 0.0 end) n_cur
      from (select side, value v from src where value is not null) group by v),
w as (select v, sum(n_ref) over o cr, sum(n_cur) over o cc, sum(n_ref) over () big_n, sum(n_cur) over () big_m
      from c window o as (order by v rows between unbounded preceding and current row))
select 'value' feature, v, round(cr / big_n, 6) cdf_ref, round(cc / big_m, 6) cdf_cur from w
""")
def ecdf(spark, sf):
    ref, cur = _events_sides(spark, sf)
    e = D.ecdf(D.stack_sides(ref, cur, ["value"]), ["value"])
    return round_doubles(e.select("feature", "v", "cdf_ref", "cdf_cur"))


@query("align_categories", LI_SRC.replace("src as", "with src as", 1) + """
select feature, category, cast(n_ref as bigint) n_ref, cast(n_cur as bigint) n_cur from (
  select feature, v category, sum(case when side = 'reference' then 1 else 0 end) n_ref,
         sum(case when side = 'current' then 1 else 0 end) n_cur from (
    select side, 'l_returnflag' feature, l_returnflag v from src union all
    select side, 'l_linestatus', l_linestatus from src) group by all)
""")
def align_categories(spark, sf):
    ref, cur = _li_sides(spark, sf)
    cc = D.category_counts(D.stack_sides(ref, cur, LI_CAT), LI_CAT)
    return cc.select("feature", "category", F.col("n_ref").cast("bigint"), F.col("n_cur").cast("bigint"))


@query("stack_reference_current", LI_SRC.replace("src as", "with src as", 1) + """
select side, count(*) n, round(avg(l_extendedprice), 6) avg_price from src group by side
""")
def stack_reference_current(spark, sf):
    ref, cur = _li_sides(spark, sf)
    st = D.stack_sides(ref, cur, LI_NUM + LI_CAT)
    return st.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 6).alias(
        "avg_price"))


@query("flatten_features", """
select event_id, cast(json_extract_string(props, '$.k') as int) as k from events
""")
def flatten_features(spark, sf):
    e = tbl(spark, sf, "events")
    return D.flatten_features(e, "props", None, "int").select("event_id", "k")


@query("drift_report")
def drift_report(spark, sf):
    """D8 for every model and drift type: reference = first half of its log, current = its newest
    ``D.NEWEST_ROWS`` predictions."""
    p = D.flatten_features(M.predictions(spark, sf), "features", ["k"], "int")
    ref = p.where(F.col("timestamp") < F.lit(EVENTS_SPLIT).cast("timestamp_ntz"))
    columns = dict(zip(M.DRIFT_TYPES, (["k", "latency_ms", "prediction"], ["prediction"], ["actual"], ["k"]), strict=True))
    return D.drift_report(ref, p, columns, "2024-01-31 00:00:00")


@query("drift_report_log", "with " + M.PREDICTIONS_SQL + """
select run_id, model_name, count(*) n, 0::bigint repeated
from (select distinct model_name from predictions), (values ('run-1'), ('run-2')) r(run_id), (values (1), (2), (3), (4)) t(i)
group by run_id, model_name
""")
def drift_report_log(spark, sf):
    """D8 as a log: two runs are appended, the first of them twice; a third broke off before its commit."""
    from tessera.session import scratch_path
    from tessera.sources import datasets as DS
    path = scratch_path(spark, "drift-reports")
    reports = drift_report(spark, sf).checkpoint()
    written = [DS.append_reports(reports, path, run) for run in ("run-1", "run-1", "run-2")]
    if written != [True, False, True]:
        raise RuntimeError(f"appended {written}")
    reports.limit(1).write.parquet(f"{path}/runs/run_id=run-3")
    rows = DS.read_reports(spark, path)
    return rows.groupBy("run_id", "model_name").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("report_id")).alias("repeated"))
