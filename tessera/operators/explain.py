"""Exact Shapley explanations of tree ensembles (M10), for every row of a table.

The value of a set of features S, for a row x, is what the ensemble gives on average when
only S is known: at a split on a feature of S the row goes its way, at any other split it
goes both ways in proportion to the training rows that did (path-dependent expectation).

A leaf adds its value times one factor per feature on its path: for a known feature 1 or 0
(x meets all of the path's conditions on it, or not), else the share of training rows that
meet them.  For such a product the Shapley value of feature j is

    value * (o_j - z_j) * integral over u in [0, 1] of prod_{k != j} (u o_k + (1 - u) z_k)

with o the 0/1 factors and z the shares; Gauss-Legendre nodes give the integral exactly.
A leaf with d features on its path has 2**d patterns o at most, so all its answers are one
small table, worked out once on the driver; a row is then a look-up per leaf.  Leaves with
more than `PATTERN_BITS` features are integrated row by row.

Contributions and the baseline (the value of no feature) add up to the ensemble's output.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import drop_scratch, scratch_path

PATTERN_BITS = 10


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root.  ``left`` is -1 at leaves.  A row goes left if its feature is at most the
    threshold, or one of ``categories``; NaN goes left where ``nan_left`` says so."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    nan_left: np.ndarray
    categories: dict[int, frozenset] = field(default_factory=dict)

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        if node in self.categories:
            return np.isin(x, list(self.categories[node]))
        return np.where(np.isnan(x), self.nan_left[node], x <= self.threshold[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.left[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                go = self.goes_left(node, x[rows, self.feature[node]])
                todo += [(int(self.left[node]), rows[go]), (int(self.right[node]), rows[~go])]
        return out


@dataclass
class Ensemble:
    """Trees whose values add up, a constant, and the number of features."""

    trees: list[Tree]
    constant: float
    features: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.constant + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


@dataclass
class Leaf:
    """Features of a path (distinct), their shares, and for each of them the splits (node, side) on it."""

    value: float
    features: np.ndarray
    share: np.ndarray
    splits: list[list[tuple[int, bool]]]


def leaves(tree: Tree) -> list[Leaf]:
    out = []
    todo: list[tuple[int, dict[int, tuple[float, list[tuple[int, bool]]]]]] = [(0, {})]
    while todo:
        node, path = todo.pop()
        if tree.left[node] < 0:
            out.append(Leaf(float(tree.value[node]), np.array(list(path), dtype=np.int64), np.array([z for z, _ in path.values()]), [s for _, s in path.values()]))
            continue
        f = int(tree.feature[node])
        for child, side in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
            z, splits = path.get(f, (1.0, []))
            share = tree.cover[child] / tree.cover[node] if tree.cover[node] > 0 else 0.5
            todo.append((child, {**path, f: (z * share, [*splits, (node, side)])}))
    return out


def product_shapley(o: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Shapley values of the game prod_k (o_k if k is known else z_k), for rows of 0/1 patterns `o`."""
    d = len(z)
    nodes, weights = np.polynomial.legendre.leggauss(max(1, -(-d // 2)))
    out = np.zeros(o.shape)
    for u, w in zip((nodes + 1) / 2, weights / 2, strict=True):
        term = u * o + (1 - u) * z
        before = np.ones(o.shape)
        after = np.ones(o.shape)
        for k in range(1, d):  # products without one of the terms, without dividing by it
            before[:, k] = before[:, k - 1] * term[:, k - 1]
            after[:, d - 1 - k] = after[:, d - k] * term[:, d - k]
        out += w * before * after
    return (o - z) * out


class TreeExplainer:
    """Tables of an ensemble's leaves; small enough to be sent to every task."""

    def __init__(self, ensemble: Ensemble):
        self.ensemble = ensemble
        self.baseline = ensemble.constant
        self.leaves: list[list[tuple[Leaf, np.ndarray | None]]] = []
        for tree in ensemble.trees:
            own = []
            for leaf in leaves(tree):
                d = len(leaf.features)
                self.baseline += leaf.value * float(np.prod(leaf.share))
                if not d:
                    continue
                table = None
                if d <= PATTERN_BITS:
                    patterns = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(np.float64)
                    table = leaf.value * product_shapley(patterns, leaf.share)
                own.append((leaf, table))
            self.leaves.append(own)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Rows x features."""
        out = np.zeros((self.ensemble.features, len(x)))
        for tree, own in zip(self.ensemble.trees, self.leaves, strict=True):
            went = {int(n): tree.goes_left(n, x[:, tree.feature[n]]) for n in np.flatnonzero(tree.left >= 0)}
            for leaf, table in own:
                meets = [np.logical_and.reduce([went[n] == side for n, side in splits]) for splits in leaf.splits]
                if table is not None:
                    pattern = np.zeros(len(x), dtype=np.int64)
                    for k, m in enumerate(meets):
                        pattern |= m.astype(np.int64) << k
                    phi = table[pattern].T
                else:
                    phi = leaf.value * product_shapley(np.array(meets, dtype=np.float64).T, leaf.share).T
                for k, f in enumerate(leaf.features):
                    out[f] += phi[k]
        return out.T


def brute_force(ensemble: Ensemble, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Baseline and contributions of one row by the definition, over all sets of features (tests)."""
    from itertools import combinations
    from math import factorial

    n = ensemble.features

    def value(known: frozenset) -> float:
        def walk(tree: Tree, node: int) -> float:
            if tree.left[node] < 0:
                return float(tree.value[node])
            f, a, b = int(tree.feature[node]), int(tree.left[node]), int(tree.right[node])
            if f in known:
                return walk(tree, a if tree.goes_left(node, x[f : f + 1])[0] else b)
            return (tree.cover[a] * walk(tree, a) + tree.cover[b] * walk(tree, b)) / tree.cover[node]

        return ensemble.constant + sum(walk(t, 0) for t in ensemble.trees)

    held = {frozenset(s): value(frozenset(s)) for k in range(n + 1) for s in combinations(range(n), k)}
    phi = np.zeros(n)
    for s, v in held.items():
        for j in set(range(n)) - s:
            phi[j] += factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (held[s | {j}] - v)
    return held[frozenset()], phi


# ---------------------------------------------------------------- ensembles of fitted models

def _spark_trees(spark: SparkSession, model, leaf_value) -> dict[int, Tree]:
    """Trees of a fitted Spark ML tree model by number, from the node table that the model saves.  ``leaf_value`` takes
    (prediction, impurity stats) of a node."""
    path = scratch_path(spark, "tree-nodes")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" not in nodes.columns:  # a single tree has no number
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct(*nodes.columns).alias("nodeData"))
    # bounded by the model, which the driver holds anyway
    rows = nodes.select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    drop_scratch(spark, path)
    out = {}
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    for number, own in by_tree.items():
        place = {r["id"]: i for i, r in enumerate(own)}
        inner = [r["leftChild"] >= 0 for r in own]
        threshold, categories = np.zeros(len(own)), {}
        for i, r in enumerate(own):
            if inner[i]:
                s = r["split"]
                if s["numCategories"] == -1:
                    threshold[i] = s["leftCategoriesOrThreshold"][0]
                else:
                    categories[i] = frozenset(s["leftCategoriesOrThreshold"])
        out[number] = Tree(
            np.array([r["split"]["featureIndex"] if k else -1 for r, k in zip(own, inner, strict=True)]), threshold,
            np.array([place[r["leftChild"]] if k else -1 for r, k in zip(own, inner, strict=True)]),
            np.array([place[r["rightChild"]] if k else -1 for r, k in zip(own, inner, strict=True)]),
            np.array([leaf_value(r["prediction"], r["impurityStats"]) for r in own]), np.zeros(len(own)),
            np.zeros(len(own), dtype=bool), categories)
    return out


def _covers(trees: list[Tree], x: np.ndarray) -> None:
    for t in trees:
        reached = {0: np.arange(len(x))}
        todo = [0]
        while todo:
            node = todo.pop()
            t.cover[node] += len(reached[node])
            if t.left[node] >= 0:
                go = t.goes_left(node, x[reached[node], t.feature[node]])
                for child, rows in ((int(t.left[node]), reached[node][go]), (int(t.right[node]), reached[node][~go])):
                    reached[child] = rows
                    todo.append(child)


def with_covers(trees: list[Tree], features: DataFrame) -> None:
    """Sets every node's cover to the number of rows of ``features`` (a vector column) that reach it: one pass, each
    task adds up its rows, and the sums per node (a table as small as the model) come to the driver."""
    size = sum(len(t.left) for t in trees)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in trees:
            t.cover = np.zeros(len(t.left))
        for pdf in batches:
            if len(pdf):
                _covers(trees, np.stack(pdf["x"].to_numpy()))
        total = np.concatenate([t.cover for t in trees])
        yield pd.DataFrame({"node": np.arange(size), "n": total})

    x = features.select(vector_to_array("features").alias("x"))
    sums = np.zeros(size)
    for r in x.mapInPandas(count, "node long, n double").groupBy("node").agg(F.sum("n").alias("n")).collect():
        sums[r["node"]] = r["n"]
    at = 0
    for t in trees:
        t.cover = sums[at:at + len(t.left)]
        at += len(t.left)


def ensemble_of(model, spark: SparkSession, background: DataFrame, target: int = 1) -> Ensemble:
    """The ensemble behind a fitted tree model, with covers counted over ``background`` (a table with ``features``).

    Forests and trees: the probability of class ``target``.  Boosted models: the margin
    (log-odds scale), as usual for additive explanations of boosting.
    """
    from tessera.operators.boosting import BoostedTreesModel

    if isinstance(model, BoostedTreesModel):
        return model.ensemble(target)
    kind = type(model).__name__
    if kind == "RandomForestClassificationModel":
        n = model.getNumTrees
        trees = _spark_trees(spark, model, lambda _, s: (s[target] / sum(s) if sum(s) else 0.0) / n)
    elif kind == "DecisionTreeClassificationModel":
        trees = _spark_trees(spark, model, lambda _, s: s[target] / sum(s) if sum(s) else 0.0)
    elif kind == "GBTClassificationModel":
        trees = _spark_trees(spark, model, lambda p, _: p)
        for number, weight in enumerate(model.treeWeights):
            trees[number].value = trees[number].value * weight
    else:
        raise ValueError(f"{kind} is no tree model")
    own = [trees[i] for i in sorted(trees)]
    with_covers(own, background)
    return Ensemble(own, 0.0, model.numFeatures)


EXPLANATION = "baseline double, output double, contributions array<struct<feature:string,value:double,contribution:double>>"


def tree_contributions(model: PipelineModel, rows: DataFrame, background: DataFrame, names: Sequence[str],
                       id_cols: Sequence[str], target: int = 1) -> DataFrame:
    """Every row of ``rows`` with ``baseline``, ``output`` (what baseline and contributions add up to) and
    ``contributions`` (feature, value, contribution), by descending absolute contribution, ties by name.

    ``names`` are the features in the order of the model's vector; shares come from ``background``
    (the training rows).  The rows are explained where they lie: no shuffle, one batch at a time.
    """
    spark = rows.sparkSession
    prep, last = PipelineModel(stages=model.stages[:-1]), model.stages[-1]
    ensemble = ensemble_of(last, spark, prep.transform(background), target)
    shared = spark.sparkContext.broadcast((TreeExplainer(ensemble), list(names)))
    x = prep.transform(rows).select(*id_cols, vector_to_array("features").alias("__x"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name != "__x")

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        explainer, names = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["__x"].to_numpy())
            phi = explainer.contributions(x)
            out = pdf.drop(columns="__x")
            out["baseline"] = explainer.baseline
            out["output"] = explainer.baseline + phi.sum(axis=1)
            ranks = np.lexsort((np.broadcast_to(np.argsort(np.argsort(names)), phi.shape), -np.abs(phi)), axis=1)
            out["contributions"] = [[(names[j], float(x[i, j]), float(phi[i, j])) for j in ranks[i]] for i in range(len(x))]
            yield out

    return x.mapInPandas(explain, f"{kind}, {EXPLANATION}")
