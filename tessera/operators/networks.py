"""Feed-forward networks with relu or tanh and an L2 penalty (M4), by distributed mini-batches.

The training rows are kept as blocks of numbers.  In every step each task takes its share of
the step's mini-batch -- row i of a block belongs to the step that a seeded permutation of
the block's rows in this epoch deals it to -- and gives the sum of its gradients; sums meet
in ``FAN`` groups and come to the driver as ``FAN`` rows of the size of the weights, which
takes an adaptive step (Adam) and sends the weights out again.  What the driver holds grows
with the network, not with the rows.

A part of the rows is held out to stop early: training ends when their loss has not gone
down for ``patience`` epochs, and the weights of the best epoch are kept.
"""

from __future__ import annotations

import json
import math
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS, FAN = 16_384, 8
# The decay rates and the smallest divisor of the adaptive step.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def shapes(layers: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip(layers[:-1], layers[1:], strict=True))


def unpack(w: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, biases) of every layer, as views of the one vector."""
    out, at = [], 0
    for a, b in shapes(layers):
        out.append((w[at:at + a * b].reshape(a, b), w[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def start(layers: Sequence[int], activation: str, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    parts = []
    for a, b in shapes(layers):
        bound = math.sqrt((6.0 if activation == "relu" else 2.0) / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def forward(w: np.ndarray, layers: Sequence[int], activation: str, x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer; the last are the classes' margins."""
    out = [x]
    parts = unpack(w, layers)
    for i, (weight, bias) in enumerate(parts):
        z = out[-1] @ weight + bias
        if i + 1 < len(parts):
            z = np.maximum(z, 0.0) if activation == "relu" else np.tanh(z)
        out.append(z)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(w: np.ndarray, layers: Sequence[int], activation: str, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over the rows of the log loss, and its gradient (without the penalty)."""
    acts = forward(w, layers, activation, x)
    p = softmax(acts[-1])
    rows = np.arange(len(y))
    loss = -np.log(np.maximum(p[rows, y], 1e-300)).sum()
    delta = p
    delta[rows, y] -= 1.0
    parts, grads = unpack(w, layers), []
    for i in range(len(parts) - 1, -1, -1):
        grads += [delta.sum(axis=0), (acts[i].T @ delta).ravel()]
        if i:
            slope = (acts[i] > 0) if activation == "relu" else 1.0 - acts[i] ** 2
            delta = (delta @ parts[i][0].T) * slope
    return float(loss), np.concatenate(grads[::-1])


def penalty_gradient(w: np.ndarray, layers: Sequence[int], alpha: float) -> np.ndarray:
    """Of ``alpha / 2 * |weights|**2``; biases are free."""
    out, at = np.zeros_like(w), 0
    for a, b in shapes(layers):
        out[at:at + a * b] = alpha * w[at:at + a * b]
        at += a * b + b
    return out


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = BETA1 * self.m + (1 - BETA1) * g
        self.v = BETA2 * self.v + (1 - BETA2) * g * g
        rate = self.rate * math.sqrt(1 - BETA2**self.t) / (1 - BETA1**self.t)
        return w - rate * self.m / (np.sqrt(self.v) + EPSILON)


class _Params(Params):
    hiddenLayers = Param(Params._dummy(), "hiddenLayers", "units of the hidden layers", TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "'relu' or 'tanh'", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "L2 penalty", TypeConverters.toFloat)
    learningRate = Param(Params._dummy(), "learningRate", "first step size", TypeConverters.toFloat)
    maxEpochs = Param(Params._dummy(), "maxEpochs", "passes over the rows at most", TypeConverters.toInt)
    stepsPerEpoch = Param(Params._dummy(), "stepsPerEpoch", "mini-batches of a pass", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "epochs without a better held-out loss; 0: no rows are held out", TypeConverters.toInt)
    tolerance = Param(Params._dummy(), "tolerance", "what counts as better", TypeConverters.toFloat)
    heldOut = Param(Params._dummy(), "heldOut", "share of rows held out", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "classes 0, 1, ...", TypeConverters.toString)
    model = Param(Params._dummy(), "model", "weights as JSON", TypeConverters.toString)


class NetworkClassifier(Estimator, _Params, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator for ``NetworkModel``.  Features are standardised inside (mean and deviation of the training rows)."""

    @keyword_only
    def __init__(self, *, hiddenLayers=(100,), activation="relu", alpha=1e-4, learningRate=1e-3, maxEpochs=50, stepsPerEpoch=4, patience=10, tolerance=1e-4,
                 heldOut=0.1, seed=42, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(hiddenLayers=[100], activation="relu", alpha=1e-4, learningRate=1e-3, maxEpochs=50, stepsPerEpoch=4, patience=10, tolerance=1e-4,
                         heldOut=0.1, seed=42, featuresCol="features", labelCol="label")
        self._set(**{k: list(v) if k == "hiddenLayers" else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        o = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        if o["activation"] not in ("relu", "tanh"):
            raise ValueError(f"activation must be 'relu' or 'tanh', not {o['activation']!r}")
        context = dataset.sparkSession.sparkContext
        data = dataset.select(vector_to_array(F.col(o["featuresCol"])).alias("x"), F.col(o["labelCol"]).cast("int").alias("y"))
        top = data.agg(F.max("y"), F.max(F.size("x")), F.count("*")).first()
        if not top[2]:
            raise ValueError("no rows to train on")
        n_features, n_classes = top[1], max(top[0] + 1, 2)
        # a row a feature
        moments = {r["f"]: (r["m"], r["s"]) for r in data.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
        mean = np.array([moments[f][0] for f in range(n_features)])
        scale = np.array([moments[f][1] or 1.0 for f in range(n_features)])
        layers = [n_features, *o["hiddenLayers"], n_classes]
        activation = o["activation"]

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), BLOCK_ROWS):
                    part = pdf.iloc[a:a + BLOCK_ROWS]
                    x = (np.stack(part["x"].to_numpy()) - mean) / scale
                    yield pd.DataFrame({"x": [x.tobytes()], "y": [part["y"].to_numpy(dtype=np.int64).tobytes()], "n": [len(part)]})

        # a block's number seeds its permutations; after the checkpoint it is part of the data
        blocks = data.mapInPandas(cut, "x binary, y binary, n long").withColumn("block", F.monotonically_increasing_id()).checkpoint()
        held = o["heldOut"] if o["patience"] > 0 else 0.0
        total = blocks.select(F.sum("n")).first()[0]
        steps = max(1, min(o["stepsPerEpoch"], total))
        seed = o["seed"]

        def pick(block: int, n: int, epoch: int, step: int) -> np.ndarray:
            """Rows of the block in the step's mini-batch; step -1: the rows held out."""
            out = np.random.Generator(np.random.PCG64([seed, block])).random(n) < held
            if step < 0:
                return np.flatnonzero(out)
            rows = np.flatnonzero(~out)
            dealt = np.random.Generator(np.random.PCG64([seed, block, epoch + 1])).permutation(len(rows))
            return rows[(dealt + block) % steps == step]

        def sums(w: np.ndarray, epoch: int, step: int) -> tuple[float, np.ndarray, int]:
            shared = context.broadcast(w)

            def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                loss, grad, n, first = 0.0, np.zeros(len(shared.value)), 0, None
                for pdf in batches:
                    for b in pdf.to_dict("records"):
                        first = b["block"] if first is None else min(first, b["block"])
                        rows = pick(b["block"], b["n"], epoch, step)
                        if len(rows):
                            x, y = np.frombuffer(b["x"]).reshape(b["n"], -1)[rows], np.frombuffer(b["y"], dtype=np.int64)[rows]
                            one, g = loss_and_gradient(shared.value, layers, activation, x, y)
                            loss, grad, n = loss + one, grad + g, n + len(rows)
                if n:
                    yield pd.DataFrame({"part": [first], "loss": [loss], "grad": [grad.tobytes()], "n": [n]})

            def add(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("part")  # in one order, so that sums don't depend on arrival
                grad = np.sum([np.frombuffer(g) for g in pdf["grad"]], axis=0)
                return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "loss": [pdf["loss"].sum()], "grad": [grad.tobytes()], "n": [int(pdf["n"].sum())]})

            kind = "part long, loss double, grad binary, n long"
            got = blocks.mapInPandas(local, kind).groupBy(F.pmod(F.hash("part"), F.lit(FAN)).alias("__fan")).applyInPandas(add, kind).collect()
            shared.unpersist()
            got = sorted(got, key=lambda r: r["part"])
            grad = np.sum([np.frombuffer(r["grad"]) for r in got], axis=0) if got else np.zeros(len(w))
            return sum(r["loss"] for r in got), grad, sum(r["n"] for r in got)

        w = start(layers, activation, seed)
        adam = Adam(len(w), o["learningRate"])
        best, best_w, poor, losses = math.inf, w, 0, []
        for epoch in range(o["maxEpochs"]):
            seen, loss = 0, 0.0
            for step in range(steps):
                one, grad, n = sums(w, epoch, step)
                if n:
                    w = adam.step(w, (grad + penalty_gradient(w, layers, o["alpha"])) / n)
                    seen, loss = seen + n, loss + one
            losses.append(loss / max(seen, 1))
            now = losses[-1]
            if held:
                one, _, n = sums(w, epoch, -1)
                now = one / n if n else now
            if now < best - o["tolerance"]:
                best, best_w, poor = now, w, 0
            else:
                poor += 1
                if o["patience"] and poor >= o["patience"]:
                    break
        model = NetworkModel()
        doc = {"layers": layers, "activation": activation, "w": best_w.tolist(), "mean": mean.tolist(), "scale": scale.tolist(), "losses": losses}
        model._set(model=json.dumps(doc), featuresCol=o["featuresCol"])
        return model


class NetworkModel(Model, _Params, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction`` (margins), ``probability`` and ``prediction``."""

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", model="{}")

    def doc(self) -> dict:
        return json.loads(self.getOrDefault("model"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        doc = self.doc()
        state = tuple(np.array(doc[k]) for k in ("w", "mean", "scale"))
        shared = dataset.sparkSession.sparkContext.broadcast((*state, doc["layers"], doc["activation"]))

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            w, mean, scale, layers, activation = shared.value
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(forward(w, layers, activation, (np.stack(x.to_numpy()) - mean) / scale)[-1]))

        m = F.col("__margins")
        top = F.array_max(m)
        soft = F.transform(m, lambda v: F.exp(v - top))
        out = dataset.withColumn("__margins", margins(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
        probability = F.transform(soft, lambda e: e / F.aggregate(soft, F.lit(0.0), lambda a, v: a + v))
        out = out.withColumns({"rawPrediction": array_to_vector(m), "probability": array_to_vector(probability), "prediction": (F.array_position(m, top) - 1).cast("double")})
        return out.drop("__margins")
