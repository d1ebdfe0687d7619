"""Streaming monitors over a prediction stream (ST1–ST6, ST8, ST9).

Input: a streaming DataFrame with the prediction-log columns and an event-time
``timestamp`` column of type ``timestamp``.  Windowed aggregates use watermarks
(append mode emits each window once, when it is closed; later rows are dropped
and counted by the query progress).  Custom state (``applyInPandasWithState``,
``transformWithStateInPandas``) is bounded per key.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import stats as S
from tessera.operators.metrics import LATENCY_BUCKETS
from tessera.session import ROCKSDB_PROVIDER

TS = "timestamp"


def _window_cols(w: str = "w") -> list[Column]:
    return [F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"),
            F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end")]


def prediction_counts(stream: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """ST1: predictions per model, version and status per tumbling window."""
    return (stream.withWatermark(TS, delay)
            .groupBy(F.window(TS, window).alias("w"), "model_name", "model_version", "status")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*_window_cols(), "model_name", "model_version", "status", "n"))


def error_rate(stream: DataFrame, delay: str = "10 minutes", window: str = "5 minutes",
               slide: str = "1 minute") -> DataFrame:
    """ST2: error share per model over sliding windows (a rate over ``window``)."""
    return (stream.withWatermark(TS, delay)
            .groupBy(F.window(TS, window, slide).alias("w"), "model_name")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors"))
            .select(*_window_cols(), "model_name", "n", "errors",
                    (F.col("errors") * 100.0 / F.col("n")).alias("error_rate")))


def latency_histogram(stream: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """ST3: cumulative latency buckets per window (one row per window with all bounds)."""
    sec = F.col("latency_ms") / 1000.0
    aggs = [F.count_if(sec <= F.lit(float(b))).alias(f"le_{i}") for i, b in enumerate(LATENCY_BUCKETS)]
    return (stream.withWatermark(TS, delay).groupBy(F.window(TS, window).alias("w"), "model_name")
            .agg(*aggs, F.count(F.lit(1)).alias("le_inf"))
            .select(*_window_cols(), "model_name", *[f"le_{i}" for i in range(len(LATENCY_BUCKETS))], "le_inf"))


# ---------------------------------------------------------------- ST4 prediction cache

CACHE_STATE = "pending_ms array<bigint>, pending_ids array<bigint>, stored_ms bigint"
CACHE_OUT = "cache_key string, prediction_id bigint, timestamp timestamp_ntz, cached boolean"


def _cache_fn(ttl_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            ms, ids, stored = state.get
            ms, ids, stored = list(ms), list(ids), int(stored)
        else:
            ms, ids, stored = [], [], -1
        if not state.hasTimedOut:
            for pdf in pdfs:
                ms += (pd.to_datetime(pdf[TS]).astype("datetime64[us]").astype("int64") // 1000).tolist()
                ids += pdf["prediction_id"].tolist()
        now = state.getCurrentWatermarkMs()
        out = []
        later = []
        for t, i in sorted(zip(ms, ids, strict=True)):
            if t >= now:
                later.append((t, i))
                continue
            hit = stored >= 0 and t - stored < ttl_ms
            if not hit:
                stored = t
            out.append((key[0], i, pd.Timestamp(t * 1_000_000), hit))
        if later:
            state.update(([t for t, _ in later], [i for _, i in later], stored))
            state.setTimeoutTimestamp(max(later[0][0], now + 1))
        elif stored >= 0 and stored + ttl_ms > now:
            state.update(([], [], stored))
            state.setTimeoutTimestamp(max(stored + ttl_ms, now + 1))
        elif state.exists:
            state.remove()
        if not out:
            return
        yield pd.DataFrame(out, columns=["cache_key", "prediction_id", "timestamp", "cached"]).astype(
            {"prediction_id": "int64", "timestamp": "datetime64[ns]", "cached": "bool"})
    return fn


def prediction_cache(stream: DataFrame, key: str, ttl_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """ST4: a cache with a time to live, per key and in event time (milliseconds).

    A request is ``cached`` if the last request that was not lies less than
    ``ttl_seconds`` before it; else it is served afresh and stored.  Requests are judged
    in the order of (time, id) once the watermark has passed them, so the result is the
    same for any division into micro-batches.  State per key: the requests within the
    watermark's delay and one time, which goes when it has expired.
    """
    s = stream.withWatermark(TS, delay).select(F.col(key).alias("cache_key"), "prediction_id", TS)
    return s.groupBy("cache_key").applyInPandasWithState(
        _cache_fn(ttl_seconds * 1000), CACHE_OUT, CACHE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ground_truth_join(preds: DataFrame, actuals: DataFrame, delay: str = "1 hour",
                      max_lag: str = "1 hour") -> DataFrame:
    """ST5: predictions left-outer-joined with actuals arriving up to ``max_lag`` later.

    Both sides are watermarked and the time-range condition bounds the state;
    unmatched predictions are emitted (actual NULL) once the watermark passes.
    """
    p = preds.withWatermark(TS, delay).alias("p")
    a = actuals.withWatermark("actual_ts", delay).alias("a")
    cond = ((F.col("p.prediction_id") == F.col("a.actual_id"))
            & (F.col("a.actual_ts") >= F.col(f"p.{TS}"))
            & (F.col("a.actual_ts") <= F.col(f"p.{TS}") + F.expr(f"INTERVAL {max_lag}")))
    return p.join(a, cond, "leftOuter").select(
        "p.prediction_id", "p.model_name", "p.prediction", F.col(f"p.{TS}").cast("timestamp_ntz").alias(TS),
        "a.actual", F.col("a.actual_ts").cast("timestamp_ntz").alias("actual_ts"))


# ---------------------------------------------------------------- ST6 rolling accuracy

CHUNK = "ts_us array<bigint>, ids array<bigint>, correct array<bigint>"
ROLLING_OUT = "model_name string, buffered bigint, rolling_accuracy double, last_ts timestamp_ntz"
#: Sub-buffers of a model.
ROLLING_SALTS = 16

Chunk = tuple[np.ndarray, np.ndarray, np.ndarray]


def _newest(chunks: Sequence[Chunk], n: int) -> Chunk:
    """The newest ``n`` of all rows, by time and then id, in order."""
    ts, ids, correct = (np.concatenate([np.asarray(c[i], dtype="int64") for c in chunks] or [np.zeros(0, dtype="int64")]) for i in range(3))
    order = np.lexsort((ids, ts))[-n:]
    return ts[order], ids[order], correct[order]


def _chunk_row(model, chunk: Chunk) -> pd.DataFrame:
    return pd.DataFrame({"model_name": [model], "ts_us": [chunk[0].tolist()], "ids": [chunk[1].tolist()], "correct": [chunk[2].tolist()]})


def _trim_fn(buffer: int):
    """Of the rows of a partition, each model's newest ``buffer`` as one chunk per sub-buffer."""
    def fn(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Chunk] = {}
        for pdf in pdfs:
            ts = pd.to_datetime(pdf[TS]).astype("datetime64[us]").astype("int64").to_numpy()
            correct = (pdf["actual"] == pdf["prediction"]).to_numpy(dtype="int64")
            ids = pdf["prediction_id"].to_numpy(dtype="int64")
            for key, rows in pdf.groupby(["model_name", "salt"], dropna=False).indices.items():
                own = (ts[rows], ids[rows], correct[rows])
                held[key] = _newest([held[key], own] if key in held else [own], buffer)
        for (model, salt), chunk in held.items():
            yield _chunk_row(model, chunk).assign(salt=salt)
    return fn


class _Buffer(StatefulProcessor):
    """Newest ``buffer`` rows of a key, as a list of chunks: a batch appends one, and the list is written
    anew only when it holds twice as many rows as it needs."""

    def __init__(self, buffer: int):
        self.buffer = buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getListState("chunks", CHUNK)

    def take(self, pdfs: Iterator[pd.DataFrame]) -> tuple[Chunk, Chunk]:
        """(newest rows of all, those of them that have just come)."""
        new: Chunk | None = None
        for pdf in pdfs:
            for ts, ids, correct in zip(pdf["ts_us"], pdf["ids"], pdf["correct"], strict=True):
                new = _newest([(ts, ids, correct)] if new is None else [new, (ts, ids, correct)], self.buffer)
        old = [tuple(c) for c in self.chunks.get()] if self.chunks.exists() else []
        every = _newest([*old, new], self.buffer)
        # the time and id from which on rows count; newer ones than that have come now
        least = (every[0][0], every[1][0])
        came = (new[0] > least[0]) | ((new[0] == least[0]) & (new[1] >= least[1]))
        fresh = tuple(x[came] for x in new)
        if sum(len(c[0]) for c in old) + len(fresh[0]) > 2 * self.buffer:
            self.chunks.put([tuple(x.tolist() for x in every)])
        elif len(fresh[0]):
            self.chunks.appendValue(tuple(x.tolist() for x in fresh))
        return every, fresh

    def close(self) -> None:
        pass


class _SubBuffer(_Buffer):
    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 -- the names that Spark calls
        _, fresh = self.take(rows)
        if len(fresh[0]):
            yield _chunk_row(key[0], fresh)


class _MergedBuffer(_Buffer):
    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        (ts, _, correct), _ = self.take(rows)
        yield pd.DataFrame({"model_name": [key[0]], "buffered": [len(ts)], "rolling_accuracy": [float(correct.mean())],
                            "last_ts": [pd.Timestamp(int(ts[-1]), unit="us")]})


def rolling_accuracy(stream: DataFrame, buffer: int = 10_000, salts: int = ROLLING_SALTS) -> DataFrame:
    """ST6: accuracy over each model's newest ``buffer`` predictions, updated per batch.

    Each partition of a batch keeps its newest rows; they meet in sub-buffers, one for each
    model and salt, which pass on what is new in them; the model's buffer merges these.  A
    task sees ``salts * buffer`` rows of a model at most, and the state of a key holds twice
    the buffer at most, however large the model's share of the stream is.  Needs the RocksDB
    state store (``use_rocksdb``).
    """
    use_rocksdb(stream.sparkSession)
    s = stream.select("model_name", F.pmod(F.xxhash64("prediction_id"), F.lit(salts)).alias("salt"), "prediction_id",
                      F.col(TS).cast("timestamp_ntz").alias(TS), "actual", "prediction")
    chunk = f"model_name string, {CHUNK}"
    parts = s.mapInPandas(_trim_fn(buffer), f"{chunk}, salt bigint")
    subs = parts.groupBy("model_name", "salt").transformWithStateInPandas(_SubBuffer(buffer), chunk, "append", "none")
    return subs.groupBy("model_name").transformWithStateInPandas(_MergedBuffer(buffer), ROLLING_OUT, "append", "none")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of these operators needs the RocksDB store; queries started later in the session use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


# ---------------------------------------------------------------- ST8 held alerts

ALERT_STATE = "minutes array<bigint>, totals array<bigint>, errors array<bigint>, run bigint, last bigint, start bigint"
ALERT_OUT = "model_name string, alert_start timestamp_ntz, alert_minute timestamp_ntz, minutes_held bigint, "\
            "error_rate double"
MINUTE_MS = 60_000


class _HeldRule(StatefulProcessor):
    """The rule of one model over closed minutes.  State: the counts of the trailing minutes, the last minute that was
    judged, and the run of breaches; it goes when the trailing minutes are empty."""

    def __init__(self, threshold_pct: float, hold: int, span: int):
        self.threshold, self.hold, self.span = threshold_pct, hold, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rule", ALERT_STATE)

    def load(self) -> None:
        self.counts, self.run, self.last, self.start = {}, 0, None, -1
        if self.state.exists():
            minutes, totals, errors, self.run, self.last, self.start = self.state.get()
            self.counts = {m: (n, e) for m, n, e in zip(minutes, totals, errors, strict=True)}

    def judge(self, key, until: int) -> list[tuple]:
        """Minutes behind the last judged one, up to ``until``."""
        out = []
        while self.last < until:
            self.last += 1
            self.counts = {m: c for m, c in self.counts.items() if m > self.last - self.span}
            now = [c for m, c in self.counts.items() if m <= self.last]
            n, e = sum(c[0] for c in now), sum(c[1] for c in now)
            if n and 100.0 * e / n > self.threshold:
                self.start = self.last if self.run == 0 else self.start
                self.run += 1
                if self.run == self.hold:
                    out.append((key[0], pd.Timestamp(self.start * MINUTE_MS, unit="ms"), pd.Timestamp(self.last * MINUTE_MS, unit="ms"), self.run, 100.0 * e / n))
            else:
                self.run = 0
            if not self.counts:  # all further minutes are empty, up to the next row
                self.last = until
        return out

    def save(self) -> None:
        if not self.counts:
            self.state.clear()
            return
        minutes = sorted(self.counts)
        self.state.update((minutes, [self.counts[m][0] for m in minutes], [self.counts[m][1] for m in minutes], self.run, self.last, self.start))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer((self.last + 2) * MINUTE_MS)  # the end of the next minute

    @staticmethod
    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["model_name", "alert_start", "alert_minute", "minutes_held", "error_rate"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        self.load()
        out = []
        every = pd.concat(list(rows)).sort_values("minute")  # a row a minute
        for minute, n, errors in zip(every["minute"].tolist(), every["n"].tolist(), every["errors"].tolist(), strict=True):
            self.last = minute - 1 if self.last is None else self.last
            out += self.judge(key, minute - 1)
            self.counts[minute] = (n, errors)
            out += self.judge(key, minute)
        self.save()
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.load()
        if self.last is None:
            return
        out = self.judge(key, timerValues.getCurrentWatermarkInMs() // MINUTE_MS - 1)
        self.save()
        if out:
            yield self.frame(out)

    def close(self) -> None:
        pass


def held_alerts(stream: DataFrame, threshold_pct: float = 5.0, hold_minutes: int = 5,
                delay: str = "2 minutes", span_minutes: int = 5) -> DataFrame:
    """ST8: alert when a model's error share over the trailing ``span_minutes``,
    evaluated every minute, stays above ``threshold_pct`` for ``hold_minutes``
    consecutive evaluations (a rate rule with ``for: 5m``); empty windows do not breach.

    Two stateful operators: counts per minute and model, emitted when the watermark closes
    the minute, and the rule, which sees one row a minute and model, and is woken by a timer
    for minutes without any.  The state of a rule is ``span_minutes`` counts.
    """
    use_rocksdb(stream.sparkSession)
    minutes = (stream.withWatermark(TS, delay).groupBy(F.window(TS, "1 minute").alias("w"), "model_name")
               .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors")))
    rows = minutes.select("model_name", F.window_time("w").alias("at"), F.floor(F.unix_micros("w.start") / (MINUTE_MS * 1000)).alias("minute"), "n", "errors")
    return rows.groupBy("model_name").transformWithStateInPandas(_HeldRule(threshold_pct, hold_minutes, span_minutes), ALERT_OUT, "append", "eventTime")


# ---------------------------------------------------------------- ST9 drift against a static reference

def windowed_psi(stream: DataFrame, value: str, edges: Sequence[float], ref_shares: Sequence[float],
                 delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """ST9: PSI of each closed window against fixed reference bins.

    The reference edges/shares are static (computed once from the reference
    data); each window's bin counts are conditional counts in one aggregation,
    and PSI is a projection over them -- a single stateful operator.
    """
    inner = list(edges)[1:-1]
    x = F.col(value)
    code = sum([F.when(x > F.lit(float(e)), 1).otherwise(0) for e in inner], F.lit(0))
    nb = len(inner) + 1
    agg = (stream.withWatermark(TS, delay).withColumn("__bin", code)
           .groupBy(F.window(TS, window).alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("__bin") == i).alias(f"b{i}") for i in range(nb)]))
    terms = [S.psi_term(F.col(f"b{i}") / F.col("n"), F.lit(float(ref_shares[i]))) for i in range(nb)]
    return agg.select(*_window_cols(), "n", sum(terms[1:], terms[0]).alias("psi"))
