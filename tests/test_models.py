"""Tree explanations, second-order boosting, networks and model-based search, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import boosting as B
from tessera.operators import explain as EX
from tessera.operators import ml as ML
from tessera.operators import networks as NN
from tessera.operators import search as S

NAMES = [f"f{i}" for i in range(8)]


def table(spark, n=600, seed=1, classes=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 8)).round(2)
    x[:, 7] = r.integers(0, 4, n)
    z = x[:, 0] * x[:, 1] + (x[:, 2] > 0.3) + 0.5 * x[:, 7] + 0.2 * r.normal(size=n)
    y = np.digitize(z, np.quantile(z, np.arange(1, classes) / classes))
    pdf = pd.DataFrame(x, columns=NAMES).assign(id=np.arange(n), label=y.astype(float))
    pdf["cat"] = np.array(["a", "b", "c", "d"])[x[:, 7].astype(int)]
    return spark.createDataFrame(pdf).repartition(3), x, y


def fitted(spark, estimator, categorical=()):
    df, x, y = table(spark)
    names = [n for n in NAMES if not categorical or n != "f7"]
    return Pipeline(stages=[*ML.feature_pipeline(names, categorical), estimator]).fit(df), df, [*names, *categorical]


# ---------------------------------------------------------------- M10

@pytest.mark.parametrize("kind", ["random_forest", "tree", "gbt", "xgboost", "lightgbm", "categorical"])
def test_contributions_are_exact(spark, kind):
    """They and the baseline add up to the model's output, and equal the definition over all sets of features."""
    est = {
        "random_forest": lambda: ML.trainers()["random_forest"].build({"n_estimators": 5, "max_depth": 6, "max_features": "all"}),
        "categorical": lambda: ML.trainers()["random_forest"].build({"n_estimators": 5, "max_depth": 5, "max_features": "all"}),
        "tree": lambda: DecisionTreeClassifier(maxDepth=7, seed=1),
        "gbt": lambda: GBTClassifier(maxIter=4, maxDepth=4, seed=1),
        "xgboost": lambda: ML.trainers()["xgboost"].build({"n_estimators": 3, "max_depth": 4}),
        "lightgbm": lambda: ML.trainers()["lightgbm"].build({"n_estimators": 3, "num_leaves": 9, "min_child_samples": 5}),
    }[kind]()
    model, df, names = fitted(spark, est, ("cat",) if kind == "categorical" else ())
    ex = EX.tree_contributions(model, df, df, names, ["id"])
    margin = kind in ("gbt", "xgboost", "lightgbm")
    scored = model.transform(df).select("id", vector_to_array("rawPrediction" if margin else "probability")[1].alias("p"), vector_to_array("features").alias("x"))
    rows = ex.join(scored, "id").orderBy("id").collect()
    assert len(rows) == 600
    for r in rows:
        total = r.baseline + sum(c.contribution for c in r.contributions)
        assert abs(total - r.p) < 1e-9 and abs(r.output - total) < 1e-12
        size = [abs(c.contribution) for c in r.contributions]
        assert size == sorted(size, reverse=True) and {c.feature for c in r.contributions} == set(names)
    ensemble = EX.ensemble_of(model.stages[-1], spark, PipelineModel(stages=model.stages[:-1]).transform(df))
    for r in rows[::60]:
        base, phi = EX.brute_force(ensemble, np.array(r.x))
        got = {c.feature: c.contribution for c in r.contributions}
        assert abs(base - r.baseline) < 1e-9
        assert max(abs(got[n] - v) for n, v in zip(names, phi, strict=True)) < 1e-9


def test_deep_paths_without_tables(monkeypatch):
    """Leaves with more features than a table holds are integrated row by row: the same numbers."""
    r = np.random.default_rng(3)
    n = 31
    left = np.array([2 * i + 1 if 2 * i + 1 < n else -1 for i in range(n)])
    right = np.where(left >= 0, left + 1, -1)
    tree = EX.Tree(r.integers(0, 8, n), r.normal(size=n), left, right, r.normal(size=n), np.zeros(n), np.zeros(n, dtype=bool))
    x = r.normal(size=(300, 8))
    x[::7, 3] = np.nan
    EX._covers([tree], x)
    tree.cover += 1e-9
    one = EX.TreeExplainer(EX.Ensemble([tree], 0.5, 8))
    monkeypatch.setattr(EX, "PATTERN_BITS", 1)
    two = EX.TreeExplainer(EX.Ensemble([tree], 0.5, 8))
    assert np.allclose(one.contributions(x), two.contributions(x), atol=1e-12)
    assert np.allclose(one.baseline + one.contributions(x).sum(axis=1), EX.Ensemble([tree], 0.5, 8).predict(x))


def test_no_tree_model_raises(spark):
    df, _, _ = table(spark)
    model = Pipeline(stages=[*ML.feature_pipeline(NAMES), ML.trainers(600)["logistic_regression"].build({})]).fit(df)
    with pytest.raises(ValueError, match="no tree model"):
        EX.tree_contributions(model, df, df, NAMES, ["id"])


# ---------------------------------------------------------------- M2

def brute_split(x, g, h, p):
    """Best split by trying every value of every feature."""
    soft = lambda v: np.sign(v) * max(abs(v) - p["alpha"], 0)
    s = lambda a, b: soft(a) ** 2 / (b + p["lambda"])
    best = (-np.inf, None, None)
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            if min(h[left].sum(), h[~left].sum()) < p["min_child_weight"] or min(left.sum(), (~left).sum()) < p["min_child_samples"]:
                continue
            gain = (s(g[left].sum(), h[left].sum()) + s(g[~left].sum(), h[~left].sum()) - s(g.sum(), h.sum())) / 2 - p["gamma"]
            if gain > best[0] + 1e-12:
                best = (gain, f, v)
    return best


def brute_tree(x, g, h, p, depth, leaves, by_leaf):
    """Grow one tree leaf by leaf; returns the rows' values and the number of leaves."""
    n = 1
    splits = {0: brute_split(x, g, h, p)}
    parts = {0: (np.arange(len(g)), 0)}
    following = 1
    while True:
        able = [(k, splits[k]) for k in splits if splits[k][0] > 1e-12 and parts[k][1] < depth]
        if not able or (by_leaf and n >= leaves):
            break
        k, (_, f, v) = max(able, key=lambda t: (t[1][0], -t[0]))
        rows, d = parts.pop(k)
        splits.pop(k)
        go = x[rows, f] <= v
        for part in (rows[go], rows[~go]):
            parts[following] = (part, d + 1)
            splits[following] = brute_split(x[part], g[part], h[part], p)
            following += 1
        n += 1
    out = np.zeros(len(g))
    for rows, _ in parts.values():
        gs = g[rows].sum()
        out[rows] = -np.sign(gs) * max(abs(gs) - p["alpha"], 0) / (h[rows].sum() + p["lambda"])
    return out, n


@pytest.mark.parametrize("grow", ["depth", "leaf"])
def test_boosting_as_brute_force(spark, grow):
    """The same trees as one machine grows that tries every split, over several rounds."""
    df, x, y = table(spark, 250, seed=5)
    x = x.round(0)
    pdf = pd.DataFrame(x, columns=NAMES).assign(id=np.arange(len(y)), label=y.astype(float))
    df = spark.createDataFrame(pdf).repartition(3)
    est = B.BoostedTrees(grow=grow, nEstimators=3, maxDepth=4, numLeaves=7, learningRate=0.5, minChildWeight=0.5, minChildSamples=4, gamma=0.05, regAlpha=0.3, regLambda=0.7)
    model = Pipeline(stages=[*ML.feature_pipeline(NAMES), est]).fit(df)
    p = {"alpha": 0.3, "lambda": 0.7, "gamma": 0.05, "min_child_weight": 0.5, "min_child_samples": 4}
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    sizes = []
    for _ in range(3):
        q = 1 / (1 + np.exp(-score))
        value, n = brute_tree(x, q - y, q * (1 - q), p, 4, 7, grow == "leaf")
        score = score + 0.5 * value
        sizes.append(n)
    got = np.array([r.p for r in model.transform(df).orderBy("id").select(vector_to_array("rawPrediction")[1].alias("p")).collect()])
    assert [int((t.left < 0).sum()) for r in model.stages[-1].trees() for t in r] == sizes
    assert np.abs(got - score).max() < 1e-9


def test_boosting_of_classes_as_brute_force(spark):
    """One tree a class and round, on softmax gradients."""
    df, x, y = table(spark, 200, seed=6, classes=3)
    x = x.round(0)
    df = spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(id=np.arange(len(y)), label=y.astype(float))).repartition(2)
    est = B.BoostedTrees(grow="leaf", nEstimators=2, maxDepth=3, numLeaves=5, learningRate=0.3, minChildWeight=0.1, minChildSamples=2, regLambda=1.0)
    model = Pipeline(stages=[*ML.feature_pipeline(NAMES), est]).fit(df)
    p = {"alpha": 0.0, "lambda": 1.0, "gamma": 0.0, "min_child_weight": 0.1, "min_child_samples": 2}
    score = np.tile(np.log(np.bincount(y) / len(y)), (len(y), 1))
    for _ in range(2):
        q = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        score = score + 0.3 * np.stack([brute_tree(x, q[:, k] - (y == k), 2 * q[:, k] * (1 - q[:, k]), p, 3, 5, True)[0] for k in range(3)], axis=1)
    got = np.array([r.p for r in model.transform(df).orderBy("id").select(vector_to_array("rawPrediction").alias("p")).collect()])
    assert np.abs(got - score).max() < 1e-9


def test_boosting_learns_classes_nan_and_round_trip(spark, tmp_path):
    """Three classes, missing values, samples of rows and features; probabilities add up; a saved model scores the same."""
    df, x, y = table(spark, 900, classes=3)
    df = df.withColumn("f0", F.when(F.col("id") % 9 == 0, float("nan")).otherwise(F.col("f0")))
    from pyspark.ml.feature import VectorAssembler

    est = B.BoostedTrees(grow="leaf", nEstimators=8, numLeaves=8, subsample=0.8, colsample=0.8, learningRate=0.4)
    model = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep"), est]).fit(df)
    out = model.transform(df).select("id", "label", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect()
    assert all(len(r.p) == 3 and abs(sum(r.p) - 1) < 1e-9 and r.p[int(r.prediction)] == max(r.p) for r in out)
    assert np.mean([r.label == r.prediction for r in out]) > 0.7
    ML.save_model(model, str(tmp_path / "m"))
    again = ML.load_model(str(tmp_path / "m")).transform(df).select("id", "label", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect()
    assert again == out
    same = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep"), est]).fit(df)
    assert same.stages[-1].doc() == model.stages[-1].doc()


def test_boosting_odd_tables(spark):
    """One class, constant features, one row: a constant model; none: an error."""
    from pyspark.ml.linalg import Vectors

    for rows in ([(Vectors.dense([1.0, 2.0]), 0.0)] * 5, [(Vectors.dense([1.0, 2.0]), 0.0), (Vectors.dense([1.0, 2.0]), 1.0)], [(Vectors.dense([1.0, 2.0]), 1.0)]):
        df = spark.createDataFrame(rows, ["features", "label"])
        got = B.BoostedTrees(nEstimators=2).fit(df).transform(df).select("probability").distinct().collect()
        assert len(got) == 1
    with pytest.raises(ValueError, match="no rows"):
        B.BoostedTrees().fit(df.where("false"))


# ---------------------------------------------------------------- M4

@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_gradient_as_differences(activation):
    r = np.random.default_rng(2)
    layers = [4, 5, 3, 3]
    w = NN.start(layers, activation, 7)
    x, y = r.normal(size=(11, 4)), r.integers(0, 3, 11)
    _, g = NN.loss_and_gradient(w, layers, activation, x, y)
    for i in range(len(w)):
        d = np.zeros(len(w))
        d[i] = 1e-6
        up, down = (NN.loss_and_gradient(w + s * d, layers, activation, x, y)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-4
    assert np.count_nonzero(NN.penalty_gradient(w, layers, 0.1)) == 4 * 5 + 5 * 3 + 3 * 3


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_network_fits_xor(spark, activation):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(a), float(b)]), float(a ^ b)) for a in (0, 1) for b in (0, 1)] * 10
    df = spark.createDataFrame(rows, ["features", "label"]).repartition(2)
    model = NN.NetworkClassifier(hiddenLayers=[8], activation=activation, learningRate=0.1, maxEpochs=40, stepsPerEpoch=1, patience=0, alpha=1e-5).fit(df)
    assert model.transform(df).where("prediction <> label").count() == 0
    losses = model.doc()["losses"]
    assert losses[-1] < 0.1 < losses[0]


def test_network_stops_early_and_round_trip(spark, tmp_path):
    df, _, _ = table(spark, 400)
    est = NN.NetworkClassifier(hiddenLayers=[6, 4], learningRate=0.05, maxEpochs=60, stepsPerEpoch=2, patience=2, tolerance=0.05)
    model = Pipeline(stages=[*ML.feature_pipeline(NAMES), est]).fit(df)
    assert 2 < len(model.stages[-1].doc()["losses"]) < 60
    out = model.transform(df).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in out)
    ML.save_model(model, str(tmp_path / "m"))
    assert ML.load_model(str(tmp_path / "m")).transform(df).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect() == out


# ---------------------------------------------------------------- M5

SPACE = {"x": S.Number(0.0, 1.0), "rate": S.Number(1e-4, 1.0, log=True), "n": S.Number(1, 40, whole=True), "kind": S.Choice(("a", "b", "c")), "extra": S.Number(0.0, 1.0)}
NEEDS = {"extra": ("n", 20)}


def planted(p):
    value = -((p["x"] - 0.83) ** 2) * 4 - (np.log10(p["rate"]) + 2.5) ** 2 / 4 - ((p["n"] - 31) / 40) ** 2
    return value - {"a": 0.3, "b": 0.0, "c": 0.5}[p["kind"]] - (p["extra"] - 0.2) ** 2 if "extra" in p else value - 1


def test_search_is_deterministic_and_in_range():
    run = lambda ps: [planted(p) for p in ps]
    one, two = (S.search(SPACE, run, 30, seed=3, needs=NEEDS) for _ in range(2))
    assert one == two and len(one) == 30
    assert one != S.search(SPACE, run, 30, seed=4, needs=NEEDS)
    for t in one:
        p = t.params
        assert 0 <= p["x"] <= 1 and 1e-4 <= p["rate"] <= 1 and isinstance(p["n"], int) and 1 <= p["n"] <= 40 and p["kind"] in "abc"
        assert ("extra" in p) == (p["n"] >= 20)


def test_search_beats_random_draws():
    """At equal trials, on a planted optimum, over twenty seeds."""
    wins, ours, others = 0, [], []
    for seed in range(20):
        a = S.best_trial(S.search(SPACE, lambda ps: [planted(p) for p in ps], 60, seed=seed, needs=NEEDS)).value
        rng = random.Random(seed)
        b = max(planted(S.random_draw(SPACE, NEEDS, rng)) for _ in range(60))
        wins += a > b
        ours.append(a)
        others.append(b)
    assert wins >= 15 and np.mean(ours) > np.mean(others) / 2


def test_search_goes_on_after_failures():
    def run(ps):
        return [ValueError("no fit") if p["kind"] == "c" else float("nan") if p["n"] == 1 else planted(p) for p in ps]

    trials = S.search(SPACE, run, 40, seed=1, needs=NEEDS)
    assert len(trials) == 40 and any(t.value is None for t in trials)
    assert S.best_trial(trials).params["kind"] != "c"
    with pytest.raises(ValueError, match="no trial"):
        S.best_trial(S.search(SPACE, lambda ps: [ValueError("no fit")] * len(ps), 5))


def test_tune_finds_the_strong_model(spark):
    df, _, _ = table(spark, 300)
    folds = ML.stratified_folds(df, "label", ["id"], 2)
    space = {"max_depth": S.Number(1, 6, whole=True), "n_estimators": S.Number(1, 6, whole=True)}
    build = lambda p: GBTClassifier(maxIter=p["n_estimators"], maxDepth=p["max_depth"], seed=1)
    got = [ML.tune(folds, build, space, ML.feature_pipeline(NAMES), n_trials=5, startup=2, parallelism=2, n_folds=2, metric="accuracy") for _ in range(2)]
    assert got[0] == got[1] and got[0][1] > 0.6


class _Linear:
    """Probability 0.1 a + 0.2 b; keeps what it scored."""

    def __init__(self):
        self.seen = []

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector

        self.seen.append(df)
        p = 0.1 * F.col("a") + 0.2 * F.col("b")
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def test_sampled_shapley_deals_out_few_rows(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "9")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(i, float(i), float(i % 3)) for i in range(12)]
    df = own.createDataFrame([*rows, rows[0], (None, 2.0, 1.0)], "id long, a double, b double").coalesce(1)
    model = _Linear()
    got = {(r.id, r.feature): r.contribution for r in ML.sampled_shapley(model, df, df, ["a", "b"], "id", n_permutations=3).collect()}
    means = df.agg(F.avg("a"), F.avg("b")).first()
    for i, a, b in [*rows, (None, 2.0, 1.0)]:
        assert got[i, "a"] == pytest.approx(0.1 * (a - means[0])) and got[i, "b"] == pytest.approx(0.2 * (b - means[1]))
    assert len(got) == 26
    points = model.seen[0]
    assert points.rdd.getNumPartitions() >= 9 and points.count() == 14 * 3 * 3  # a point more than features for each permutation


def test_tune_fits_in_tasks_by_values(spark):
    seen = []
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")

    class Spy:
        def __init__(self, estimator):
            self.estimator = estimator

        def fit(self, data):
            seen.append(data.rdd.getNumPartitions())
            return self.estimator.fit(data)

    df = own.createDataFrame([(i, float(i % 7), float(i % 2)) for i in range(60)], "id long, x double, label double")
    folds = ML.stratified_folds(df, "label", ["id"], 2).repartition(11).persist()
    tr = ML.trainers(60, 1, 2)["logistic_regression"]
    ML.tune(folds, lambda p: Spy(tr.build(p)), tr.space, ML.feature_pipeline(["x"]), n_trials=2, startup=2, parallelism=1)
    folds.unpersist()
    assert len(seen) == 4 and set(seen) == {1}
