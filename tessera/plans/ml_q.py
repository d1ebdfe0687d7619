"""Spark ML queries.

Training runs are rows-only checks (model fits have no SQL equivalent); splits,
folds and linear explanations have DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ml as ML
from tessera.plans.common import query, r6, round_doubles, tbl
from tessera.session import scratch_path

LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _features(spark, sf):
    """One feature for each dimension of the embeddings."""
    n = tbl(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return [f"e{i}" for i in range(n or 0)]


def _embeddings(spark, sf):
    """Embeddings as a binary task (label < 5) over all of their dimensions."""
    e = tbl(spark, sf, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(name)
                                for i, name in enumerate(_features(spark, sf))], (F.col("label") < 5).cast("int").alias("y"))


@query("stratified_split", """
with r as (select o_orderstatus, row_number() over (partition by o_orderstatus
                                                    order by md5(cast(o_orderkey as varchar) || '42')) rk,
                  count(*) over (partition by o_orderstatus) n from orders)
select o_orderstatus, case when rk <= floor(n * 0.7) then 'train' when rk <= floor(n * 0.85) then 'validation'
                           else 'test' end split, count(*) n
from r group by all
""")
def stratified_split(spark, sf):
    o = tbl(spark, sf, "orders")
    s = ML.stratified_split(o, "o_orderstatus", ["o_orderkey"], 0.7, 0.15, 42)
    return s.groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_folds", """
with r as (select o_orderstatus, row_number() over (partition by o_orderstatus
                                                    order by md5(cast(o_orderkey as varchar) || '42')) rk from orders)
select o_orderstatus, cast((rk - 1) % 5 as int) fold, count(*) n from r group by all
""")
def stratified_folds(spark, sf):
    o = tbl(spark, sf, "orders")
    f = ML.stratified_folds(o, "o_orderstatus", ["o_orderkey"], 5, 42)
    return f.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


# Fixed, modest parameters for the registered runs (the search ranges stay the defaults of ``tune``).
RUN_PARAMS = {
    "random_forest": {"n_estimators": 50, "max_depth": 6, "max_features": "sqrt"},
    "xgboost": {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.8},
    "lightgbm": {"n_estimators": 6, "max_depth": 6, "num_leaves": 10, "learning_rate": 0.2, "min_child_samples": 10},
    "gradient_boosting": {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1},
    "neural_network": {"n_layers": 1, "n_units_l0": 32, "activation": "relu", "alpha": 1e-3, "learning_rate_init": 0.01,
                       "max_epochs": 15, "steps_per_epoch": 2},
}


def _run(spark, sf, model_type, n_trials=2, folds=2):
    r = ML.train_pipeline(_embeddings(spark, sf), "y", ["vec_id"], _features(spark, sf), (), model_type, n_trials, folds,
                          params=RUN_PARAMS.get(model_type))
    if r.status != "completed":
        raise RuntimeError(r.error)
    return ML.run_record(spark, r, "embeddings-binary", "emb_classifier").select(
        "model_type", "status", F.round(F.col("metrics")["accuracy"], 6).alias("accuracy"),
        F.round(F.col("metrics")["f1_score"], 6).alias("f1_score"),
        F.round(F.col("metrics")["roc_auc"], 6).alias("roc_auc"))


@query("train_random_forest")
def train_random_forest(spark, sf):
    return _run(spark, sf, "random_forest")


@query("train_gbt")
def train_gbt(spark, sf):
    return _run(spark, sf, "xgboost", n_trials=1)


@query("train_lightgbm")
def train_lightgbm(spark, sf):
    return _run(spark, sf, "lightgbm", n_trials=1)


@query("train_gradient_boosting")
def train_gradient_boosting(spark, sf):
    return _run(spark, sf, "gradient_boosting", n_trials=1)


@query("train_logistic")
def train_logistic(spark, sf):
    return _run(spark, sf, "logistic_regression", n_trials=3)


@query("train_mlp")
def train_mlp(spark, sf):
    return _run(spark, sf, "neural_network", n_trials=1)


@query("training_status", """
with n as (select label < 5 as y, count(*) n from embeddings where label is not null group by 1),
t as (select cast(sum(n - floor(n * (1.0::double - 0.15::double - 0.15::double + 0.15::double))) as bigint) k from n)
select m model_type, 'completed' status, k test_rows, true metrics_hold
from t, (values ('lightgbm'), ('logistic_regression'), ('random_forest')) v(m)
""")
def training_status(spark, sf):
    """M1-M3, M6: each run's status and the rows it was tested on; its metrics lie in their ranges."""
    params = {**RUN_PARAMS, "logistic_regression": {"C": 1.0}}
    out = None
    for m in ("lightgbm", "logistic_regression", "random_forest"):
        r = ML.train_pipeline(_embeddings(spark, sf), "y", ["vec_id"], _features(spark, sf), (), m, params=params[m])
        row = ML.run_record(spark, r, "embeddings-binary", "emb_classifier")
        out = row if out is None else out.unionByName(row)
    metric = F.col("metrics")
    shares = [metric[k].between(0, 1) for k in ("accuracy", "precision", "recall", "f1_score", "roc_auc")]
    return out.select("model_type", "status", metric["prediction_count"].cast("bigint").alias("test_rows"),
                      F.coalesce(shares[0] & shares[1] & shares[2] & shares[3] & shares[4] & (metric["log_loss"] >= 0), F.lit(False)).alias("metrics_hold"))


@query("tune")
def tune(spark, sf):
    """Model-based search with stratified k-fold CV (foldCol) for logistic regression; the
    first three trials are random."""
    data = ML.with_label(_embeddings(spark, sf), "y")
    folds = ML.stratified_folds(data, "label", ["vec_id"], 3).persist()
    tr = ML.trainers(folds.count(), len(_features(spark, sf)), 2)["logistic_regression"]
    best, cv_f1 = ML.tune(folds, tr.build, tr.space, ML.feature_pipeline(_features(spark, sf)), n_trials=6,
                         startup=3, parallelism=3)
    folds.unpersist()
    return spark.createDataFrame([(k, str(v)) for k, v in best.items()], "param string, value string").withColumn(
        "cv_f1", F.lit(round(cv_f1, 6)))


@query("train_pipeline")
def train_pipeline(spark, sf):
    """The run record of one full pipeline (split, tune, refit, evaluate, importances)."""
    r = ML.train_pipeline(_embeddings(spark, sf), "y", ["vec_id"], _features(spark, sf), (), "logistic_regression", 3, 3)
    return ML.run_record(spark, r, "embeddings-binary", "emb_classifier").drop("run_id", "started_at",
                                                                               "completed_at")


@query("compare_models")
def compare_models(spark, sf):
    return ML.compare_models(_embeddings(spark, sf), "y", ["vec_id"], _features(spark, sf),
                             ["logistic_regression", "random_forest", "xgboost"], n_trials=2, cv_folds=2,
                             params=RUN_PARAMS)


@query("feature_importance")
def feature_importance(spark, sf):
    r = ML.train_pipeline(_embeddings(spark, sf), "y", ["vec_id"], _features(spark, sf), (), "random_forest", 1, 2,
                          params=RUN_PARAMS["random_forest"])
    return spark.createDataFrame(r.importances, "feature_name string, importance_score double, "
                                                "importance_type string")


def _fit_lineitem_model(spark, sf):
    li = tbl(spark, sf, "lineitem").withColumn("y", (F.col("l_linestatus") == "F").cast("int"))
    data = ML.with_label(li, "y")
    from pyspark.ml import Pipeline
    stages = [*ML.feature_pipeline(LI_FEATURES), ML.trainers(1, 4, 2)["logistic_regression"].build({"C": 1.0})]
    # the training part of the stratified split, by the row's own columns
    train = ML.stratified_split(data, "label", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return Pipeline(stages=stages).fit(train.where(F.col("split") == "train")), li


@query("batch_score", """
select 'ok' status, count(*) n, cast(0 as bigint) rejected, true probabilities_hold from lineitem where l_tax <> 0
union all
select 'failed', count(*), count(*), true from lineitem where l_tax = 0 having count(*) > 0
""")
def batch_score(spark, sf):
    """Score all of lineitem; rows with a missing tax (0 → NULL) fail individually."""
    model, li = _fit_lineitem_model(spark, sf)
    records = li.withColumn("l_tax", F.when(F.col("l_tax") != 0, F.col("l_tax"))).withColumn(
        "row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    out = ML.batch_score(model, records, LI_FEATURES, "row_id", LI_FEATURES)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == -1).alias(
        "rejected"), F.coalesce(F.bool_and(F.col("probability").between(0.5, 1.0)), F.lit(True)).alias("probabilities_hold"))


@query("model_save_load", "select count(*) n, cast(0 as bigint) differing from lineitem")
def model_save_load(spark, sf):
    """Persist the fitted pipeline, load it back, and score with the loaded copy."""
    model, li = _fit_lineitem_model(spark, sf)
    path = scratch_path(spark, "model-lineitem-lr")
    ML.save_model(model, path)
    loaded = ML.load_model(path)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = model.transform(li).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("p"))
    b = loaded.transform(li).groupBy(*key).agg(F.sum("prediction").alias("q"))
    return a.join(b, key, "left").agg(F.sum("n").alias("n"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("differing"))


# A declared linear model (logit scale), as loaded from a registry: fixed coefficients.
LINEAR_MODEL = {"coefficients": {"l_quantity": 0.04, "l_extendedprice": -0.00002, "l_discount": 3.0,
                                 "l_tax": -5.0},
                "intercept": -0.3}


@query("explain_linear", """
with m as (select avg(l_quantity) mq, avg(l_extendedprice) mp, avg(l_discount) md, avg(l_tax) mt from lineitem),
c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
             -0.3 + 0.04 * mq + -0.00002 * mp + 3.0 * md + -5.0 * mt baseline,
             [{'feature': 'l_quantity', 'c': 0.04 * (l_quantity - mq)},
              {'feature': 'l_extendedprice', 'c': -0.00002 * (l_extendedprice - mp)},
              {'feature': 'l_discount', 'c': 3.0 * (l_discount - md)},
              {'feature': 'l_tax', 'c': -5.0 * (l_tax - mt)}] cs
      from lineitem, m),
s as (select *, list_sort(list_transform(cs, lambda x: {'a': -abs(x.c), 'feature': x.feature, 'c': x.c})) srt from c)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(baseline, 6) baseline,
       srt[1].feature top_feature, round(srt[1].c, 6) top_contribution,
       array_to_string(list_transform(srt, lambda x: x.feature), ',') ranking
from s
""")
def explain_linear(spark, sf):
    li = tbl(spark, sf, "lineitem")
    means = li.agg(*[F.avg(c).alias(c) for c in LINEAR_MODEL["coefficients"]])
    ex = ML.linear_contributions(li, LINEAR_MODEL["coefficients"], LINEAR_MODEL["intercept"], means)
    return ex.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("baseline").alias("baseline"),
                     F.col("contributions")[0]["feature"].alias("top_feature"),
                     r6(F.col("contributions")[0]["contribution"]).alias("top_contribution"),
                     F.array_join(F.transform("contributions", lambda c: c["feature"]), ",").alias("ranking"))


@query("explain_shapley")
def explain_shapley(spark, sf):
    """Sampled Shapley contributions of a random forest, for every embedding row."""
    from pyspark.ml import Pipeline
    data = ML.with_label(_embeddings(spark, sf), "y")
    model = Pipeline(stages=[*ML.feature_pipeline(_features(spark, sf)),
                             ML.trainers()["random_forest"].build({"n_estimators": 30, "max_depth": 5})]).fit(data)
    sh = ML.sampled_shapley(model, data, data, _features(spark, sf), "vec_id", n_permutations=4)
    return sh.groupBy("feature").agg(F.round(F.avg(F.abs("contribution")), 6).alias("mean_abs_contribution"))


def _explained(spark, sf):
    """A forest of the embeddings with the exact contributions of every row, and the scored rows."""
    from pyspark.ml import Pipeline

    from tessera.operators import explain as EX
    data = ML.with_label(_embeddings(spark, sf), "y")
    names = _features(spark, sf)
    model = Pipeline(stages=[*ML.feature_pipeline(names), ML.trainers()["random_forest"].build({"n_estimators": 20, "max_depth": 5})]).fit(data)
    return model.transform(data), EX.tree_contributions(model, data, data, names, ["vec_id"])


@query("explain_trees")
def explain_trees(spark, sf):
    """M10, exact: each feature's mean absolute contribution over all embeddings, and how often it is the first."""
    _, ex = _explained(spark, sf)
    each = ex.select("vec_id", F.posexplode("contributions").alias("pos", "c"))
    return each.groupBy("c.feature").agg(F.round(F.avg(F.abs("c.contribution")), 6).alias("mean_abs_contribution"),
                                         F.count_if(F.col("pos") == 0).alias("first"))


@query("explain_trees_additive", "select count(*) n, cast(0 as bigint) differing, true sorted from embeddings")
def explain_trees_additive(spark, sf):
    """Baseline and contributions of every row add up to the model's probability, largest contribution first."""
    from pyspark.ml.functions import vector_to_array
    scored, ex = _explained(spark, sf)
    both = scored.select("vec_id", vector_to_array("probability")[1].alias("p")).join(ex, "vec_id")
    size = F.transform("contributions", lambda c: F.abs(c["contribution"]))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("p") - F.col("output")) > 1e-9).alias("differing"),
                    F.coalesce(F.bool_and(size == F.reverse(F.array_sort(size))), F.lit(True)).alias("sorted"))


@query("top_contributions", """
with m as (select avg(l_quantity) mq, avg(l_extendedprice) mp, avg(l_discount) md, avg(l_tax) mt from lineitem),
c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
             [{'feature': 'l_quantity', 'c': 0.04 * (l_quantity - mq)},
              {'feature': 'l_extendedprice', 'c': -0.00002 * (l_extendedprice - mp)},
              {'feature': 'l_discount', 'c': 3.0 * (l_discount - md)},
              {'feature': 'l_tax', 'c': -5.0 * (l_tax - mt)}] cs
      from lineitem, m),
s as (select *, list_sort(list_transform(cs, lambda x: {'a': -abs(x.c), 'feature': x.feature, 'c': x.c})) srt from c),
u as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(srt) e, unnest(range(1, 5)) rank from s)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(rank as int) rank, e.feature feature,
       round(e.c, 6) contribution
from u
""")
def top_contributions(spark, sf):
    """Each prediction's contributions, ranked by absolute value (one row per feature)."""
    li = tbl(spark, sf, "lineitem")
    means = li.agg(*[F.avg(c).alias(c) for c in LINEAR_MODEL["coefficients"]])
    ex = ML.linear_contributions(li, LINEAR_MODEL["coefficients"], LINEAR_MODEL["intercept"], means)
    return ex.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.posexplode("contributions").alias("pos", "c")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("pos") + 1).alias("rank"),
        F.col("c.feature").alias("feature"), r6(F.col("c.contribution")).alias("contribution"))
