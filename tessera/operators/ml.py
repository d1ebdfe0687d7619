"""Training, tuning, scoring and explanation with Spark ML.

* Splits and folds are exact per class: rows are ranked inside their class by a
  hash of (id, seed) with the distributed prefix sum, then cut at n·share -- no
  class is sorted in one task, and the result does not depend on partitioning.
* Imputation and encoding are pipeline stages fitted on the training split only.
* Tuning is k-fold cross-validation over the fold column; the parameters to try come
  from a sequential model-based search (``search.py``) over each model's ranges, a few
  trials at a time, whose fits run in parallel on the cluster.
* Scoring is ``PipelineModel.transform`` (per partition, no driver loop); bad
  records are split off by row checks and returned with an error instead.
"""

from __future__ import annotations

import math
import random
import time
import uuid
from dataclasses import dataclass, field
from typing import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.boosting import BoostedTrees
from tessera.operators.metrics import classification_metrics, log_loss, roc_auc
from tessera.operators.networks import NetworkClassifier
from tessera.operators.ranks import prefix_sums
from tessera.operators.search import Choice, Needs, Number, Space, best_trial, search

SEED = 42
#: Feature values that one task of a search's fits takes.
TASK_VALUES = 1 << 20


# ---------------------------------------------------------------- W6 splits and folds

def _class_ranks(df: DataFrame, label: str, id_cols: Sequence[str], seed: int) -> DataFrame:
    """Rank of each row inside its class by md5(id || seed), plus the class size."""
    key = F.md5(F.concat(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols]), F.lit(str(seed))))
    base = df.withColumn("__h", key).withColumn("__one", F.lit(1.0))
    ranked = prefix_sums(base, [label], ["__h"], ["__one"])
    return (ranked.withColumn("__rank", F.col("cum___one").cast("bigint")).withColumnRenamed("total___one", "__n")
            .drop("__one", "cum___one", "__h"))


def stratified_split(df: DataFrame, label: str, id_cols: Sequence[str], train: float = 0.7,
                     validation: float = 0.15, seed: int = SEED) -> DataFrame:
    """Adds ``split`` (train / validation / test) with exact class shares."""
    r = _class_ranks(df, label, id_cols, seed)
    cut1 = F.floor(F.col("__n") * train)
    cut2 = F.floor(F.col("__n") * (train + validation))
    split = (F.when(F.col("__rank") <= cut1, "train").when(F.col("__rank") <= cut2, "validation")
             .otherwise("test"))
    return r.withColumn("split", split).drop("__rank", "__n")


def stratified_folds(df: DataFrame, label: str, id_cols: Sequence[str], k: int = 5, seed: int = SEED,
                     fold_col: str = "fold") -> DataFrame:
    """Adds an integer fold column (0..k−1) balanced within every class (``foldCol``)."""
    r = _class_ranks(df, label, id_cols, seed)
    return r.withColumn(fold_col, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank", "__n")


# ---------------------------------------------------------------- G3 trainer registry

@dataclass
class Trainer:
    """A model type: how to build the estimator, and the ranges of its parameters."""

    name: str
    build: Callable[[Mapping[str, object]], object]
    space: Space
    needs: Needs = field(default_factory=dict)


# Fixed value: the deepest tree that Spark ML grows.
MAX_TREE_DEPTH = 30


def _rf(p):
    depth = int(p.get("max_depth", 10))
    if depth > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {depth} is over {MAX_TREE_DEPTH}, the deepest tree that can be grown")
    return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), maxDepth=depth,
                                  featureSubsetStrategy=str(p.get("max_features", "sqrt")),
                                  minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                                  seed=SEED, featuresCol="features", labelCol="label")


def _gbt(p):
    return GBTClassifier(maxIter=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 5)),
                         stepSize=float(p.get("learning_rate", 0.1)),
                         subsamplingRate=float(p.get("subsample", 1.0)),
                         minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=SEED,
                         featuresCol="features", labelCol="label")


def _boosted(grow: str):
    """Second-order boosting, level by level or leaf by leaf, with the defaults usual for either."""
    def build(p):
        by_leaf = grow == "leaf"
        return BoostedTrees(
            grow=grow, nEstimators=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 12 if by_leaf else 6)),
            numLeaves=int(p.get("num_leaves", 31)), learningRate=float(p.get("learning_rate", 0.1 if by_leaf else 0.3)),
            subsample=float(p.get("subsample", 1.0)), colsample=float(p.get("colsample_bytree", 1.0)),
            minChildWeight=float(p.get("min_child_weight", 1e-3 if by_leaf else 1.0)),
            minChildSamples=int(p.get("min_child_samples", 20 if by_leaf else 1)), gamma=float(p.get("gamma", 0.0)),
            regAlpha=float(p.get("reg_alpha", 0.0)), regLambda=float(p.get("reg_lambda", 0.0 if by_leaf else 1.0)), seed=SEED)
    return build


def _lr_builder(n_rows: int):
    def build(p):
        c = float(p.get("C", 1.0))
        penalty = str(p.get("penalty", "l2"))
        return LogisticRegression(regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                                  standardization=False, maxIter=int(p.get("max_iter", 1000)),
                                  featuresCol="features", labelCol="label")
    return build


def _network(p):
    hidden = [int(p.get(f"n_units_l{i}", 64)) for i in range(int(p.get("n_layers", 1)))]
    return NetworkClassifier(hiddenLayers=hidden, activation=str(p.get("activation", "relu")), alpha=float(p.get("alpha", 1e-4)),
                             learningRate=float(p.get("learning_rate_init", 1e-3)), maxEpochs=int(p.get("max_epochs", 50)),
                             stepsPerEpoch=int(p.get("steps_per_epoch", 4)), seed=SEED)


def trainers(n_rows: int = 1, n_features: int = 1, n_classes: int = 2) -> dict[str, Trainer]:
    """Model types and the ranges of their parameters.

    The names and the ranges are fixed values.  Each boosting name is an estimator of its own:
    ``gradient_boosting`` is Spark's, first order; ``xgboost`` and ``lightgbm`` are second
    order, grown by levels and by leaves.
    """
    boosting = {"n_estimators": Number(50, 500, whole=True), "max_depth": Number(3, 12, whole=True),
                "learning_rate": Number(0.01, 0.3, log=True), "subsample": Number(0.6, 1.0),
                "colsample_bytree": Number(0.6, 1.0), "reg_alpha": Number(1e-8, 10.0, log=True),
                "reg_lambda": Number(1e-8, 10.0, log=True)}
    units = {f"n_units_l{i}": Number(32, 256, whole=True) for i in range(3)}
    return {
        "random_forest": Trainer("random_forest", _rf, {
            "n_estimators": Number(50, 500, whole=True), "max_depth": Number(3, 20, whole=True),
            "min_samples_leaf": Number(1, 10, whole=True), "max_features": Choice(("sqrt", "log2", "all"))}),
        "xgboost": Trainer("xgboost", _boosted("depth"), {
            **boosting, "min_child_weight": Number(1, 10, whole=True), "gamma": Number(1e-8, 1.0, log=True)}),
        "lightgbm": Trainer("lightgbm", _boosted("leaf"), {
            **boosting, "num_leaves": Number(20, 150, whole=True), "min_child_samples": Number(5, 100, whole=True)}),
        "gradient_boosting": Trainer("gradient_boosting", _gbt, {
            "n_estimators": Number(50, 500, whole=True), "max_depth": Number(3, 10, whole=True),
            "learning_rate": Number(0.01, 0.3, log=True), "subsample": Number(0.6, 1.0),
            "min_samples_leaf": Number(1, 10, whole=True)}),
        "logistic_regression": Trainer("logistic_regression", _lr_builder(n_rows), {
            "C": Number(1e-4, 10.0, log=True), "penalty": Choice(("l1", "l2"))}),
        "neural_network": Trainer("neural_network", _network, {
            "n_layers": Number(1, 3, whole=True), **units, "activation": Choice(("relu", "tanh")),
            "alpha": Number(1e-5, 1e-1, log=True), "learning_rate_init": Number(1e-4, 1e-2, log=True)},
            {"n_units_l1": ("n_layers", 2), "n_units_l2": ("n_layers", 3)}),
    }


# ---------------------------------------------------------------- pipelines

def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Stages: index categoricals, impute numerics (mean, fitted on train), assemble."""
    stages = []
    cat_out = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        cat_out.append(f"{c}__idx")
    num_out = []
    if numeric:
        num_out = [f"{c}__imp" for c in numeric]
        stages.append(Imputer(strategy="mean", inputCols=list(numeric), outputCols=num_out))
    stages.append(VectorAssembler(inputCols=num_out + cat_out, outputCol="features", handleInvalid="keep"))
    return stages


def with_label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double"))


# The names of the tuning metrics and the evaluator metrics they stand for.
OPTIMIZATION_METRICS = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall",
                        "f1_score": "f1", "f1": "f1", "roc_auc": "areaUnderROC"}


def evaluator_for(metric: str = "f1_score"):
    if metric not in OPTIMIZATION_METRICS:
        raise ValueError(f"unknown optimization metric {metric!r}; one of {sorted(OPTIMIZATION_METRICS)}")
    name = OPTIMIZATION_METRICS[metric]
    if name == "areaUnderROC":
        return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName=name)
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=name)


def tune(train: DataFrame, estimator_for: Callable[[dict], object], space: Space,
         prep_stages: list, n_trials: int = 10, fold_col: str = "fold", seed: int = SEED,
         parallelism: int = 4, n_folds: int | None = None, metric: str = "f1_score", needs: Needs | None = None,
         startup: int = 10) -> tuple[dict, float]:
    """Sequential model-based search over ``space`` with k-fold CV on ``fold_col``: the best
    parameters and their mean ``metric`` over the folds.

    ``train`` holds the training rows only.  Preprocessing is fitted within each fold, on
    its training part, once for all trials; as a fit's passes are many, their number of tasks
    goes by the values, not by the partitions.  ``parallelism`` trials are under way at a time,
    proposed from those that are finished (``search``); the first ``startup`` are drawn at
    random.  A trial that fails counts as poor.  The caller refits the winner.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import StorageLevel, inheritable_thread_target

    if n_folds is None:
        n_folds = int(train.agg(F.max(fold_col)).first()[0]) + 1
    evaluator = evaluator_for(metric)
    tasks = max(1, math.ceil(train.count() * len(prep_stages[-1].getInputCols()) / TASK_VALUES))
    ready = []
    try:
        for fold in range(n_folds):
            prep = Pipeline(stages=prep_stages).fit(train.where(F.col(fold_col) != fold))
            ready.append(prep.transform(train).select("features", "label", fold_col).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK))

        def one(job):
            params, fold = job
            data = ready[fold]
            try:
                model = estimator_for(params).fit(data.where(F.col(fold_col) != fold))
                return float(evaluator.evaluate(model.transform(data.where(F.col(fold_col) == fold))))
            except Exception as e:  # noqa: BLE001 -- a trial may fail; the search goes on without it
                return e

        with ThreadPool(parallelism) as pool:
            def run(proposals: list[dict]) -> list:
                jobs = [(p, fold) for p in proposals for fold in range(n_folds)]
                got = pool.map(inheritable_thread_target(one), jobs, chunksize=1)
                values = [got[i * n_folds:(i + 1) * n_folds] for i in range(len(proposals))]
                return [next((v for v in own if isinstance(v, Exception)), None) or sum(own) / len(own) for own in values]

            best = best_trial(search(space, run, n_trials, seed, needs, startup, in_flight=parallelism))
        return best.params, best.value
    finally:
        for r in ready:
            r.unpersist()


def evaluate(model: PipelineModel, test: DataFrame, binary: bool) -> dict:
    """accuracy, weighted precision/recall/F1, count; ROC AUC and log loss if binary; the
    confusion matrix as ``confusion_<actual>_<predicted>`` counts.  The test rows are scored once."""
    from pyspark import StorageLevel

    scored = model.transform(test).withColumn("p1", vector_to_array("probability")[1] if binary else F.lit(None))
    scored = scored.select("label", "prediction", "p1").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _evaluated(scored, binary)
    finally:
        scored.unpersist()


def _evaluated(scored: DataFrame, binary: bool) -> dict:
    m = classification_metrics(scored, "label", "prediction").first().asDict()
    out = {k: float(v) for k, v in m.items() if k != "prediction_count" and v is not None}
    out["prediction_count"] = float(m["prediction_count"])
    if binary:
        auc = roc_auc(scored, "label", "p1").first()
        if auc and auc["roc_auc"] is not None:
            out["roc_auc"] = float(auc["roc_auc"])
        out["log_loss"] = float(log_loss(scored, "label", "p1").first()["log_loss"])
    # classes squared at most: bounded by the model's number of classes
    for r in scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect():
        out[f"confusion_{int(r['label'])}_{int(r['prediction'])}"] = float(r["n"])
    return out


def feature_importance(model: PipelineModel, names: Sequence[str]) -> list[tuple[str, float, str]]:
    """(feature, importance, type): tree importances, or |coefficient| for linear models."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals, kind = last.featureImportances.toArray().tolist(), "gini"
    elif hasattr(last, "coefficientMatrix"):
        cm = last.coefficientMatrix.toArray()
        vals, kind = [float(abs(cm[:, j]).max()) for j in range(cm.shape[1])], "coefficient"
    else:
        return []
    return [(n, float(v), kind) for n, v in zip(names, vals)]


@dataclass
class RunResult:
    run_id: str
    model_type: str
    status: str
    metrics: dict
    parameters: dict
    importances: list
    model: PipelineModel | None
    started_at: float
    completed_at: float
    error: str | None = None


def train_pipeline(df: DataFrame, label: str, id_cols: Sequence[str], numeric: Sequence[str],
                   categorical: Sequence[str] = (), model_type: str = "random_forest", n_trials: int = 5,
                   cv_folds: int = 3, seed: int = SEED, parallelism: int = 4,
                   split: DataFrame | None = None, params: Mapping[str, object] | None = None,
                   metric: str = "f1_score", test_size: float = 0.15, validation_size: float = 0.15) -> RunResult:
    """split → tune on train (k folds) → refit on train+validation → evaluate on test.

    ``metric`` picks the winner of the search; ``test_size`` and ``validation_size`` are
    shares of all rows.  Validation and test rows never reach the search.  With
    ``params`` the search is skipped and those parameters are used as given. 
    """
    from pyspark import StorageLevel

    started = time.time()
    run_id = str(uuid.uuid4())
    cached = []
    try:
        # iterative estimators re-read their input every iteration: keep the split and
        # the folds materialised (memory, spilling to disk) for the duration of the run
        if not (0 < test_size < 1 and 0 <= validation_size < 1 and test_size + validation_size < 1):
            raise ValueError("test_size and validation_size must leave a training part")
        data = split if split is not None else stratified_split(
            with_label(df, label), "label", id_cols, 1 - test_size - validation_size, validation_size, seed)
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(data)
        trainval = data.where(F.col("split") != "test")
        train = data.where(F.col("split") == "train")
        n_rows = train.count()
        n_classes = int(data.agg(F.max("label")).first()[0]) + 1
        n_feat = len(numeric) + len(categorical)
        tr = trainers(n_rows, n_feat, n_classes)[model_type]
        if params is not None:
            best, cv_score = dict(params), float("nan")
        else:
            prep = feature_pipeline(numeric, categorical)
            folds = stratified_folds(train.drop("split"), "label", id_cols, cv_folds, seed).persist(
                StorageLevel.MEMORY_AND_DISK)
            cached.append(folds)
            best, cv_score = tune(folds, tr.build, tr.space, prep, n_trials, "fold", seed, parallelism, cv_folds, metric,
                                  tr.needs)
        # refit the winner on train + validation
        final = Pipeline(stages=[*feature_pipeline(numeric, categorical), tr.build(best)]).fit(trainval)
        metrics = evaluate(final, data.where(F.col("split") == "test"), n_classes == 2)
        if cv_score == cv_score:  # not NaN
            metrics[f"cv_{metric}"] = cv_score
        names = [*numeric, *categorical]
        return RunResult(run_id, model_type, "completed", metrics, {k: str(v) for k, v in best.items()},
                         feature_importance(final, names), final, started, time.time())
    except Exception as e:  # noqa: BLE001  -- failures are kept as rows (compare_models)
        return RunResult(run_id, model_type, "failed", {}, {}, [], None, started, time.time(), str(e))
    finally:
        for c in cached:
            c.unpersist()


def run_record(spark, result: RunResult, experiment: str, model_name: str) -> DataFrame:
    """The training_runs row for a result."""
    from datetime import datetime, timezone
    ts = lambda t: datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame(
        [(result.run_id, experiment, model_name, result.model_type, result.status, result.metrics,
          result.parameters, None, ts(result.started_at), ts(result.completed_at), result.error)],
        "run_id string, experiment_name string, model_name string, model_type string, status string, "
        "metrics map<string,double>, parameters map<string,string>, artifact_path string, "
        "started_at timestamp_ntz, completed_at timestamp_ntz, error string")


def compare_models(df: DataFrame, label: str, id_cols: Sequence[str], numeric: Sequence[str],
                   model_types: Sequence[str], n_trials: int = 3, cv_folds: int = 3, seed: int = SEED,
                   params: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """M6 for each model type on one split (checkpointed once); ranked by F1, failures kept."""
    spark = df.sparkSession
    split = stratified_split(with_label(df, label), "label", id_cols, seed=seed).checkpoint(eager=True)
    results = []
    for mt in model_types:
        r = train_pipeline(df, label, id_cols, numeric, (), mt, n_trials, cv_folds, seed, split=split,
                           params=(params or {}).get(mt))
        results.append((mt, r.status, r.metrics.get("f1_score"), r.metrics.get("accuracy"), r.error))
    # one result per model type, already on the driver: rank them there (F1 desc, missing = 0)
    results.sort(key=lambda t: (-(t[2] or 0.0), t[0]))
    rows = [(*t, i + 1, i == 0 and t[1] == "completed") for i, t in enumerate(results)]
    return spark.createDataFrame(rows, "model_type string, status string, f1_score double, accuracy double, "
                                       "error string, rank int, is_best boolean")


# ---------------------------------------------------------------- M9 scoring

def batch_score(model: PipelineModel, records: DataFrame, required: Sequence[str], id_col: str,
                numeric: Sequence[str] = ()) -> DataFrame:
    """Score records; rows failing the input checks get prediction −1 and an error.

    Good rows go through ``model.transform``; probabilities become an array, the
    max-class probability and a ``{class: p}`` map.  Bad rows are not scored and
    do not affect the others.  Absent feature columns are created as 0.
    """
    for c in required:
        if c not in records.columns:
            records = records.withColumn(c, F.lit(0.0))
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    checks += [F.when(F.isnan(F.col(c).cast("double")), F.lit(f"{c} is NaN")) for c in numeric]
    tagged = records.withColumn("__errors", F.array_compact(F.array(*checks)))
    good = tagged.where(F.size("__errors") == 0)
    bad = tagged.where(F.size("__errors") > 0)
    scored = model.transform(good.drop("__errors"))
    probs = vector_to_array("probability")
    classes = F.transform(F.sequence(F.lit(0), F.size(probs) - 1), lambda i: i.cast("string"))
    ok = scored.select(id_col, F.col("prediction").cast("double").alias("prediction"),
                       F.array_max(probs).alias("probability"),
                       F.map_from_arrays(classes, probs).alias("probabilities"),
                       F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    failed = bad.select(id_col, F.lit(-1.0).alias("prediction"), F.lit(None).cast("double").alias("probability"),
                        F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit("failed").alias("status"),
                        F.array_join("__errors", "; ").alias("error"))
    return ok.unionByName(failed)


def score_distinct(model: PipelineModel, requests: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """Score each distinct feature document once, then attach the result to every request.

    ``dropDuplicates`` on the document hash, one ``transform`` of the distinct
    rows, and an equi-join back on the hash (a cache without a cache server).
    """
    distinct = requests.dropDuplicates([key_col])
    scored = model.transform(distinct).select(key_col, F.col("prediction").alias("prediction"))
    return requests.select(id_col, key_col).join(scored, key_col, "left")


# ---------------------------------------------------------------- M10 explanations

def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], intercept: float,
                         means: Mapping[str, float] | DataFrame) -> DataFrame:
    """Exact additive explanation of a linear (logit) model: β_j · (x_j − mean_j).

    ``baseline`` = intercept + Σ β_j·mean_j; contributions sorted by |value|
    descending (T3) by ``array_sort`` in natural order -- per row, no shuffle.
    """
    names = list(coefficients)
    if isinstance(means, DataFrame):
        # one merged scalar subquery, attached once per mean as a column
        df = df.withColumns({f"__mean_{n}": means.select(F.col(n)).scalar() for n in names})
        mean_of = {n: F.col(f"__mean_{n}") for n in names}
    else:
        mean_of = {n: F.lit(float(means[n])) for n in names}
    baseline = F.lit(float(intercept))
    for n in names:
        baseline = baseline + F.lit(float(coefficients[n])) * mean_of[n]
    contribs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
                                  (F.lit(float(coefficients[n])) * (F.col(n).cast("double") - mean_of[n]))
                                  .alias("contribution")) for n in names])
    # materialise the (subquery-using) array first: a lambda's input may not hold a subquery
    df = df.withColumn("baseline", baseline).withColumn("__contribs", contribs)
    # natural struct order on (-|c|, feature, ...), then the sort key goes
    keyed = F.transform("__contribs", lambda c: F.struct((-F.abs(c["contribution"])).alias("k"), c["feature"].alias("feature"),
                                                         c["value"].alias("value"), c["contribution"].alias("contribution")))
    ordered = F.transform(F.array_sort(keyed), lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value"),
                                                                  c["contribution"].alias("contribution")))
    return df.withColumn("contributions", ordered).drop("__contribs", *[f"__mean_{n}" for n in names])


def sampled_shapley(model: PipelineModel, rows: DataFrame, background: DataFrame, features: Sequence[str],
                    id_col: str, n_permutations: int = 8, seed: int = SEED, output: str = "p1") -> DataFrame:
    """Sampled Shapley values (Štrumbelj & Kononenko) for any fitted pipeline.

    A seeded permutation gives features + 1 hybrid points of a row: the first k features in
    its order come from the row, the rest from the background means.  Points that follow each
    other differ in one feature j, whose contribution is the mean difference of their
    probabilities.  The work lies in the points, so rows are dealt out first, however few
    they are; all points are scored by one ``transform``.
    """
    feats = list(features)
    spark = rows.sparkSession
    means = background.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats])
    bg = {f: means.select(f).scalar() for f in feats}
    rng = random.Random(seed)
    places = []  # by permutation, each feature's place in it, from 1
    for _ in range(n_permutations):
        order = feats[:]
        rng.shuffle(order)
        pos = {f: i for i, f in enumerate(order, 1)}
        places.append([pos[f] for f in feats])
    plan = F.array(*[F.struct(F.lit(pi).alias("perm"), F.array(*map(F.lit, own)).alias("places")) for pi, own in enumerate(places)])
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    hybrid = rows.select(id_col, *feats).repartition(spread).select("*", F.explode(plan).alias("__w")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(len(feats)))).alias("__k")).select(
        id_col, F.col("__w.perm").alias("__perm"), "__k",
        *[F.when(F.col("__w.places")[i] <= F.col("__k"), F.col(f).cast("double")).otherwise(bg[f]).alias(f)
          for i, f in enumerate(feats)])
    scored = model.transform(hybrid).withColumn(output, vector_to_array("probability")[1])
    # rows that share an id are one; the points of an id are then bounded by the plan
    points = scored.groupBy(id_col, "__perm", "__k").agg(F.max(output).alias("p"))
    held = points.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("__perm", "__k", "p"))), lambda s: s["p"]).alias("p"))
    size = len(feats) + 1
    ends = F.array(*[F.struct(F.lit(f).alias("feature"), F.array(*[F.lit(pi * size + own[i]) for pi, own in enumerate(places)]).alias("at"))
                     for i, f in enumerate(feats)])
    each = held.select(id_col, "p", F.inline(ends))
    total = F.aggregate("at", F.lit(0.0), lambda s, k: s + F.get("p", k) - F.get("p", k - 1))
    return each.select(id_col, "feature", (total / n_permutations).alias("contribution"))


# ---------------------------------------------------------------- S15

def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
