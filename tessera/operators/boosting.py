"""Second-order gradient boosting (M2) over binned features, as Spark jobs.

The training rows are binned once (approximate quantiles, at most ``max_bins`` bins a
feature and one for NaN) and kept as blocks of bytes with their current scores.  A tree
grows in passes.  In a pass every task walks its rows down the tree so far and adds up
gradient, hessian and count per (open node, feature, bin); the tasks' histograms of one
feature meet in one task (where there are many, first in ``FAN`` ones), are added up as they
come, and the best split is found there, so that only one row per (node, feature) reaches
the driver.  After a tree, one pass adds its values to the scores.

With gradient sum G and hessian sum H, a leaf gets ``-T(G) / (H + lambda)`` and a split is
worth ``(S(left) + S(right) - S(parent)) / 2 - gamma``, S = ``T(G)**2 / (H + lambda)``, T the
soft threshold by ``alpha``.  ``grow="depth"`` opens all leaves of a level; ``grow="leaf"``
opens the leaf of the greatest worth, until there are ``num_leaves``.  For the latter the
children of all waiting splits are measured in one pass, so a tree of k leaves takes about
as many passes as it is deep, not k, and is the same as if leaves were opened one by one.

More than two classes: one tree a class and round, on softmax gradients.
"""

from __future__ import annotations

import heapq
import json
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.explain import Ensemble, Tree

#: Rows of a block, sub-groups of a histogram's merge, rounds after which the scores' lineage is cut.
BLOCK_ROWS, FAN, CUT_EVERY = 65_536, 8, 10
#: Rows in which a leaf's hessian or a split's worth count as nothing.
TINY = 1e-12


def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def worth(g, h, alpha: float, lam: float):
    return soft(g, alpha) ** 2 / np.maximum(h + lam, TINY)


def best_split(hist: np.ndarray, p: dict) -> tuple[float, int, bool, np.ndarray]:
    """Of a histogram (bins x (g, h, n); bin 0 holds NaN): the worth, the last bin on the left, whether NaN goes left, and
    the left side's sums.  Worth is -inf where no split is allowed."""
    total = hist.sum(axis=0)
    left = np.cumsum(hist[1:], axis=0)[:-1]
    best = (-np.inf, 0, False, total)
    for nan_left in (False, True) if hist[0, 2] else (False,):
        a = left + hist[0] if nan_left else left
        b = total - a
        gain = (worth(a[:, 0], a[:, 1], p["alpha"], p["lambda"]) + worth(b[:, 0], b[:, 1], p["alpha"], p["lambda"])
                - worth(total[0], total[1], p["alpha"], p["lambda"])) / 2 - p["gamma"]
        ok = (np.minimum(a[:, 1], b[:, 1]) >= p["min_child_weight"]) & (np.minimum(a[:, 2], b[:, 2]) >= p["min_child_samples"])
        gain = np.where(ok, gain, -np.inf)
        k = int(np.argmax(gain)) if len(gain) else -1
        if k >= 0 and gain[k] > best[0]:
            best = (float(gain[k]), k + 1, nan_left, a[k])
    return best


def gradients(score: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the log loss, for class ``k`` (of one score a row: class 1)."""
    if score.shape[1] == 1:
        q = 1.0 / (1.0 + np.exp(-score[:, 0]))
        return q - (y == 1), q * (1 - q)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    q = e[:, k] / e.sum(axis=1)
    return q - (y == k), 2 * q * (1 - q)


class Grown:
    """A tree under construction: splits by bin, open leaves with their sums."""

    def __init__(self):
        self.feature, self.bin, self.nan_left, self.left, self.right = [-1], [0], [False], [-1], [-1]
        self.sums: list[np.ndarray] = [np.zeros(3)]

    def split(self, node: int, feature: int, last: int, nan_left: bool, left: np.ndarray) -> tuple[int, int]:
        a, b = len(self.left), len(self.left) + 1
        self.feature[node], self.bin[node], self.nan_left[node], self.left[node], self.right[node] = feature, last, nan_left, a, b
        for s in (left, self.sums[node] - left):
            self.feature.append(-1)
            self.bin.append(0)
            self.nan_left.append(False)
            self.left.append(-1)
            self.right.append(-1)
            self.sums.append(s)
        return a, b

    def merge(self, node: int) -> None:
        """Undo a split whose children are leaves; the children stay behind without a parent."""
        self.feature[node] = self.left[node] = self.right[node] = -1

    def arrays(self):
        return tuple(np.array(x) for x in (self.feature, self.bin, self.nan_left, self.left, self.right))


def walk(bins: np.ndarray, arrays) -> np.ndarray:
    """Leaf of every row."""
    feature, last, nan_left, left, right = arrays
    node = np.zeros(len(bins), dtype=np.int64)
    rows = np.arange(len(bins))
    while True:
        on = left[node[rows]] >= 0
        rows = rows[on]
        if not len(rows):
            return node
        n = node[rows]
        b = bins[rows, feature[n]]
        go = np.where(b == 0, nan_left[n], b <= last[n])
        node[rows] = np.where(go, left[n], right[n])


def _rows(b: dict, n_features: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(b["y"], dtype=np.float64)
    return np.frombuffer(b["bins"], dtype=np.uint8).reshape(len(y), n_features), y, np.frombuffer(b["score"], dtype=np.float64).reshape(len(y), k)


def _sampled(block: int, n: int, share: float, seed: int) -> np.ndarray:
    if share >= 1:
        return np.ones(n, dtype=bool)
    return np.random.Generator(np.random.PCG64([seed, block])).random(n) < share


class _Params(Params):
    nEstimators = Param(Params._dummy(), "nEstimators", "number of rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest leaf", TypeConverters.toInt)
    numLeaves = Param(Params._dummy(), "numLeaves", "leaves of a tree, grow='leaf'", TypeConverters.toInt)
    grow = Param(Params._dummy(), "grow", "'depth' or 'leaf'", TypeConverters.toString)
    learningRate = Param(Params._dummy(), "learningRate", "share of a tree's values that is added", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of the rows that a tree sees", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of the features that a tree sees", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian sum of a leaf", TypeConverters.toFloat)
    minChildSamples = Param(Params._dummy(), "minChildSamples", "least rows of a leaf", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "least worth of a split", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 penalty of leaf values", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty of leaf values", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, at most 255", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "classes 0, 1, ...", TypeConverters.toString)
    model = Param(Params._dummy(), "model", "trees as JSON", TypeConverters.toString)


class BoostedTrees(Estimator, _Params, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator for ``BoostedTreesModel``."""

    @keyword_only
    def __init__(self, *, nEstimators=100, maxDepth=6, numLeaves=31, grow="depth", learningRate=0.1, subsample=1.0, colsample=1.0,
                 minChildWeight=1.0, minChildSamples=1, gamma=0.0, regAlpha=0.0, regLambda=1.0, maxBins=255, seed=42,
                 featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(nEstimators=100, maxDepth=6, numLeaves=31, grow="depth", learningRate=0.1, subsample=1.0, colsample=1.0, minChildWeight=1.0,
                         minChildSamples=1, gamma=0.0, regAlpha=0.0, regLambda=1.0, maxBins=255, seed=42, featuresCol="features", labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        o = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        if o["grow"] not in ("depth", "leaf"):
            raise ValueError(f"grow must be 'depth' or 'leaf', not {o['grow']!r}")
        if not 2 <= o["maxBins"] <= 255:
            raise ValueError("maxBins must be between 2 and 255")
        return _Fit(dataset, o).run()


class _Fit:
    def __init__(self, dataset: DataFrame, o: dict):
        self.o = o
        self.p = {"alpha": o["regAlpha"], "lambda": o["regLambda"], "gamma": o["gamma"], "min_child_weight": o["minChildWeight"], "min_child_samples": o["minChildSamples"]}
        self.context = dataset.sparkSession.sparkContext
        data = dataset.select(vector_to_array(F.col(o["featuresCol"])).alias("x"), F.col(o["labelCol"]).cast("double").alias("y"))
        first = data.agg(F.max(F.size("x")), F.max("y"), F.count("*")).first()
        if not first[2]:
            raise ValueError("no rows to train on")
        self.features, self.classes = first[0], max(int(first[1]) + 1, 2)
        self.scores = 1 if self.classes == 2 else self.classes
        # one row of at most `maxBins` numbers a feature
        share = [i / o["maxBins"] for i in range(1, o["maxBins"])]
        x = data.select(F.posexplode("x").alias("f", "v")).where(~F.isnan("v"))
        cuts = {r["f"]: sorted(set(r["q"])) for r in x.groupBy("f").agg(F.percentile_approx("v", share, 10_000).alias("q"), F.max("v").alias("top")).select("f", F.filter("q", lambda v: v < F.col("top")).alias("q")).collect()}
        self.cuts = [np.array(cuts.get(f, [])) for f in range(self.features)]
        self.bins = max(len(c) for c in self.cuts) + 2
        counts = data.groupBy("y").count().collect()  # a row a class
        n = {int(r["y"]): r["count"] for r in counts}
        total = sum(n.values())
        share1 = min(max(n.get(1, 0) / total, TINY), 1 - TINY)
        self.base = [float(np.log(share1 / (1 - share1)))] if self.scores == 1 else [float(np.log(max(n.get(k, 0) / total, TINY))) for k in range(self.classes)]
        cuts, base, k = self.cuts, np.array(self.base), self.scores

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), BLOCK_ROWS):
                    part = pdf.iloc[a:a + BLOCK_ROWS]
                    x = np.stack(part["x"].to_numpy())
                    bins = np.stack([np.where(np.isnan(x[:, f]), 0, np.searchsorted(c, x[:, f], side="left") + 1) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
                    y = part["y"].to_numpy(dtype=np.float64)
                    yield pd.DataFrame({"bins": [bins.tobytes()], "y": [y.tobytes()], "score": [np.tile(base, (len(y), 1)).tobytes()]})

        # a block's number only seeds its sample; after the checkpoint it is part of the data
        blocks = data.mapInPandas(cut, "bins binary, y binary, score binary").withColumn("block", F.monotonically_increasing_id())
        self.blocks = blocks.checkpoint()
        self.many = self.blocks.count() > 4 * FAN
        self.held: DataFrame | None = None

    def measure(self, trees: dict[int, Grown], fresh: dict[int, list[int]], columns: np.ndarray, turn: int) -> dict[tuple[int, int], tuple]:
        """For the nodes ``fresh[k]`` of the trees in progress: the best split of each (class, node), as (worth, feature,
        bin, nan_left, left sums, sums)."""
        o, p, n_features, scores, n_bins = self.o, self.p, self.features, self.scores, self.bins
        state = self.context.broadcast({k: (t.arrays(), np.array(fresh[k])) for k, t in trees.items() if fresh[k]})
        seed = o["seed"] * 1_000_003 + turn

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            part = None
            for pdf in batches:
                for b in pdf.to_dict("records"):
                    part = b["block"] if part is None else min(part, b["block"])
                    bins, y, score = _rows(b, n_features, scores)
                    seen = _sampled(b["block"], len(y), o["subsample"], seed)
                    bins, y, score = bins[seen], y[seen], score[seen]
                    for k, (arrays, nodes) in state.value.items():
                        leaf = walk(bins, arrays)
                        place = np.full(len(arrays[0]), -1)
                        place[nodes] = np.arange(len(nodes))
                        at = place[leaf]
                        on = at >= 0
                        g, h = gradients(score, y, k)
                        slot, g, h, own = at[on] * n_bins, g[on], h[on], bins[on]
                        size = len(nodes) * n_bins
                        for f in columns:
                            i = slot + own[:, f]
                            add = np.stack([np.bincount(i, g, size), np.bincount(i, h, size), np.bincount(i, minlength=size)], axis=1)
                            key = (k, int(f))
                            sums[key] = sums[key] + add if key in sums else add
            rows = [(k, int(node), f, part, s[i * n_bins:(i + 1) * n_bins].tobytes()) for (k, f), s in sums.items() for i, node in enumerate(state.value[k][1])]
            yield pd.DataFrame(rows, columns=["k", "node", "f", "part", "hist"])

        def totals(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, np.ndarray]]:
            """((k, node, f, first part), histogram) of rows that come sorted by (k, node, f, part): in one order, so that
            sums don't depend on arrival."""
            key, first, total = None, 0, np.zeros((n_bins, 3))
            for pdf in batches:
                for k, node, f, part, raw in zip(pdf["k"], pdf["node"], pdf["f"], pdf["part"], pdf["hist"], strict=True):
                    if (k, node, f) != key:
                        if key is not None:
                            yield (*key, first), total
                        key, first, total = (k, node, f), part, np.zeros((n_bins, 3))
                    total += np.frombuffer(raw).reshape(n_bins, 3)
            if key is not None:
                yield (*key, first), total

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for key, hist in totals(batches):
                yield pd.DataFrame([(*key, hist.tobytes())], columns=["k", "node", "f", "part", "hist"])

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = []
            for (k, node, f, _), hist in totals(batches):
                gain, last, nan_left, left = best_split(hist, p)
                rows.append((k, node, f, gain, last, nan_left, left.tolist(), hist.sum(axis=0).tolist()))
            yield pd.DataFrame(rows, columns=["k", "node", "f", "gain", "bin", "nan_left", "left", "total"])

        kind = "k int, node int, f int, part long, hist binary"
        by = ["k", "node", "f", "part"]
        partial = self.blocks.select("block", "bins", "y", "score").mapInPandas(local, kind)
        if self.many:
            partial = partial.repartition("f", F.pmod(F.hash("part"), F.lit(FAN))).sortWithinPartitions(*by).mapInPandas(merge, kind)
        # a row a (node, feature)
        found = partial.repartition("f").sortWithinPartitions(*by).mapInPandas(choose, "k int, node int, f int, gain double, bin int, nan_left boolean, left array<double>, total array<double>").collect()
        out: dict[tuple[int, int], tuple] = {}
        for r in sorted(found, key=lambda r: r["f"]):
            key = (r["k"], r["node"])
            if key not in out or r["gain"] > out[key][0]:
                out[key] = (r["gain"], r["f"], r["bin"], r["nan_left"], np.array(r["left"]), np.array(r["total"]))
        state.unpersist()
        return out

    def grow(self, turn: int) -> dict[int, Grown]:
        """The trees of a round, one a class, grown side by side."""
        o = self.o
        rng = np.random.Generator(np.random.PCG64([o["seed"], turn]))
        columns = np.sort(rng.permutation(self.features)[:max(1, round(o["colsample"] * self.features))])
        trees = {k: Grown() for k in range(self.scores)}
        depth = {k: {0: 0} for k in trees}
        known: dict[int, dict[int, tuple]] = {k: {} for k in trees}
        #: waiting splits (-worth, node), and splits that were made ahead of their turn
        queue: dict[int, list] = {k: [] for k in trees}
        ahead: dict[int, set] = {k: set() for k in trees}
        n_leaves = dict.fromkeys(trees, 1)
        limit = o["numLeaves"] if o["grow"] == "leaf" else 1 << 62
        fresh = {k: [0] for k in trees}
        while any(fresh.values()):
            for (k, node), s in self.measure(trees, fresh, columns, turn).items():
                known[k][node] = s
                trees[k].sums[node] = s[5]
            for k, tree in trees.items():
                if 0 in fresh[k]:
                    self._offer(queue[k], known[k], 0, 0)
                fresh[k] = []
                took = True
                while took:
                    # no more of the waiting splits than there is room for can have their turn
                    for _, node in heapq.nsmallest(limit - n_leaves[k], queue[k]):
                        if node not in ahead[k]:
                            _, f, last, nan_left, left, _ = known[k][node]
                            for child in tree.split(node, f, last, nan_left, left):
                                depth[k][child] = depth[k][node] + 1
                                if depth[k][child] < o["maxDepth"]:
                                    fresh[k].append(child)
                            ahead[k].add(node)
                    took = False
                    while queue[k] and n_leaves[k] < limit and queue[k][0][1] in ahead[k]:
                        node = queue[k][0][1]
                        children = (tree.left[node], tree.right[node])
                        if any(depth[k][c] < o["maxDepth"] and c not in known[k] for c in children):
                            break  # they are in `fresh`
                        heapq.heappop(queue[k])
                        ahead[k].discard(node)
                        n_leaves[k] += 1
                        for child in children:
                            self._offer(queue[k], known[k], child, depth[k][child])
                        took = True
        for k, tree in trees.items():
            for node in ahead[k]:  # splits that never had their turn
                tree.merge(node)
        return trees

    def _offer(self, queue: list, known: dict, node: int, depth: int) -> None:
        if depth < self.o["maxDepth"] and node in known and known[node][0] > TINY:
            heapq.heappush(queue, (-known[node][0], node))

    def run(self) -> BoostedTreesModel:
        o, rounds = self.o, []
        for turn in range(o["nEstimators"]):
            trees = {k: self._finished(t) for k, t in self.grow(turn).items()}
            rounds.append(trees)
            if turn + 1 < o["nEstimators"]:
                self._add(trees, turn)
        if self.held is not None:
            self.held.unpersist()
        doc = {"base": self.base, "features": self.features, "trees": [[r[k] for k in sorted(r)] for r in rounds]}
        model = BoostedTreesModel()
        model._set(model=json.dumps(doc), featuresCol=o["featuresCol"])
        return model

    def _finished(self, t: Grown) -> dict:
        """A tree as plain lists, its unreachable nodes left out."""
        place, order = {0: 0}, [0]
        for node in order:
            if t.left[node] >= 0:
                for child in (t.left[node], t.right[node]):
                    place[child] = len(order)
                    order.append(child)
        leaf = [t.left[n] < 0 for n in order]
        value = [float(-soft(t.sums[n][0], self.p["alpha"]) / max(t.sums[n][1] + self.p["lambda"], TINY) * self.o["learningRate"]) for n in order]
        return {
            "feature": [t.feature[n] for n in order], "bin": [int(t.bin[n]) for n in order],
            "threshold": [0.0 if x else self._threshold(t.feature[n], t.bin[n]) for n, x in zip(order, leaf, strict=True)],
            "nan_left": [bool(t.nan_left[n]) for n in order], "left": [-1 if x else place[t.left[n]] for n, x in zip(order, leaf, strict=True)],
            "right": [-1 if x else place[t.right[n]] for n, x in zip(order, leaf, strict=True)], "value": value, "cover": [float(t.sums[n][2]) for n in order],
        }

    def _threshold(self, feature: int, last: int) -> float:
        cuts = self.cuts[feature]
        return float(cuts[last - 1]) if last <= len(cuts) else float("inf")

    def _add(self, trees: dict[int, dict], turn: int) -> None:
        n_features, scores = self.features, self.scores
        state = self.context.broadcast({k: (tuple(np.array(t[x]) for x in ("feature", "bin", "nan_left", "left", "right")), np.array(t["value"])) for k, t in trees.items()})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for b in pdf.to_dict("records"):
                    bins, _, score = _rows(b, n_features, scores)
                    score = score.copy()
                    for k, (arrays, value) in state.value.items():
                        score[:, k] += value[walk(bins, arrays)]
                    out.append(score.tobytes())
                yield pdf.assign(score=out)

        now = self.blocks.mapInPandas(add, "bins binary, y binary, score binary, block long")
        if (turn + 1) % CUT_EVERY == 0:
            now = now.checkpoint()
            if self.held is not None:
                self.held.unpersist()
            self.held = None
        else:
            now = now.persist(StorageLevel.MEMORY_AND_DISK)
            now.count()
            if self.held is not None:
                self.held.unpersist()
            self.held = now
        self.blocks = now


class BoostedTreesModel(Model, _Params, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction`` (margins), ``probability`` and ``prediction``."""

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", model="{}")

    def doc(self) -> dict:
        return json.loads(self.getOrDefault("model"))

    def trees(self) -> list[list[Tree]]:
        """By round and class."""
        return [[Tree(*(np.array(t[x]) for x in ("feature", "threshold", "left", "right", "value", "cover", "nan_left"))) for t in r] for r in self.doc()["trees"]]

    @property
    def numFeatures(self) -> int:  # noqa: N802 -- as other models name it
        return self.doc()["features"]

    @property
    def featureImportances(self):  # noqa: N802
        """Share of the training rows' splits by feature: covers of the nodes that split on it."""
        from pyspark.ml.linalg import Vectors

        total = np.zeros(self.numFeatures)
        for r in self.trees():
            for t in r:
                inner = t.left >= 0
                np.add.at(total, t.feature[inner], t.cover[inner])
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def ensemble(self, target: int = 1) -> Ensemble:
        """Margin of the class, with the covers of training."""
        doc, k = self.doc(), (0 if len(self.doc()["base"]) == 1 else target)
        sign = -1.0 if len(doc["base"]) == 1 and target == 0 else 1.0
        trees = [r[k] for r in self.trees()]
        for t in trees:
            t.value = sign * t.value
        return Ensemble(trees, sign * doc["base"][k], doc["features"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        doc = self.doc()
        shared = dataset.sparkSession.sparkContext.broadcast((self.trees(), np.array(doc["base"])))

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            rounds, base = shared.value
            if not len(x):
                return pd.Series([], dtype=object)
            x = np.stack(x.to_numpy())
            out = np.tile(base, (len(x), 1))
            for r in rounds:
                for k, t in enumerate(r):
                    out[:, k] += t.predict(x)
            return pd.Series(list(np.concatenate([-out, out], axis=1) if len(base) == 1 else out))

        m = F.col("__margins")
        binary = len(doc["base"]) == 1
        top = F.array_max(m)
        soft_max = F.transform(m, lambda v: F.exp(v - top))
        probability = F.array(1 / (1 + F.exp(m[1])), 1 / (1 + F.exp(-m[1]))) if binary else F.transform(soft_max, lambda e: e / F.aggregate(soft_max, F.lit(0.0), lambda a, v: a + v))
        out = dataset.withColumn("__margins", margins(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
        out = out.withColumns({"rawPrediction": array_to_vector(m), "probability": array_to_vector(probability), "prediction": (F.array_position(m, top) - 1).cast("double")})
        return out.drop("__margins")
