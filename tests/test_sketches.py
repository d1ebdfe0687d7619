"""Mergeable summaries, the report log, medians by ranks, and streams on chained keyed state."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.operators import sketches as SK
from tessera.sources import datasets as DS
from tessera.streaming import io as SIO
from tessera.streaming import monitors as MON

# ---------------------------------------------------------------- A13


def test_merged_quantiles_within_the_bound(spark):
    """Sketches of many windows, merged: the ranks of the quantiles are off by the bound at most."""
    r = np.random.default_rng(4)
    n = 40_000
    x = np.concatenate([r.lognormal(3, 1, n // 2), r.normal(500, 3, n // 2)])
    pdf = pd.DataFrame({"m": np.where(np.arange(n) % 3 == 0, "a", "b"), "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(r.integers(0, 86_400, n), unit="s"), "x": x})
    df = spark.createDataFrame(pdf, "m string, t timestamp_ntz, x double").repartition(6)
    sketches = SK.latency_sketches(df, ["m"], "t", "x", "10 minutes")
    assert sketches.count() == 2 * 144
    probs = (0.05, 0.5, 0.95, 0.99)
    for row in SK.merged_latency(sketches, ["m"], probs).collect():
        own = np.sort(pdf.x[pdf.m == row.m].to_numpy())
        assert row.total_predictions == len(own) and math.isclose(row.mean_ms, own.mean())
        for p in probs:
            rank = np.searchsorted(own, row[f"p{p * 100:g}_ms"], side="right") / len(own)
            assert abs(rank - p) <= 2 * row.rank_error + 1 / len(own)
    assert SK.rank_error(200) == pytest.approx(0.0133, abs=2e-4) and SK.rank_error() < 0.004


def test_latency_without_values(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "m string, x double").withColumn("t", F.lit("2024-01-01 00:00:10").cast("timestamp_ntz"))
    got = {r.m: r for r in SK.merged_latency(SK.latency_sketches(df, ["m"], "t", "x"), ["m"]).collect()}
    assert (got["a"].total_predictions, got["a"].mean_ms, got["a"].p95_ms) == (2, None, None)
    assert (got["b"].total_predictions, got["b"].mean_ms, got["b"].p95_ms) == (1, 2.0, 2.0)
    assert SK.merged_latency(SK.latency_sketches(df.where("false"), ["m"], "t", "x"), ["m"]).count() == 0


# ---------------------------------------------------------------- S6 / A1


def test_profile_of_versions_reads_no_rows(spark, tmp_path):
    """Merged from the stored profiles after the data are gone; equal to the profile of all rows."""
    import shutil

    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.arange(5000), "x": r.normal(1e6, 1, 5000), "c": r.choice(["u", "v", "w", None], 5000)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf, "k long, x double, c string").withColumn("x", F.nanvl("x", F.lit(None)))
    root, table = str(tmp_path / "data"), str(tmp_path / "profiles")
    for i in range(5):
        DS.write_dataset_version(df.where(F.col("k") % 5 == i), root, "d", f"v{i}", profile_table=table)
    one = DS.write_dataset_version(df.limit(0), root, "d", "v9", profile_table=table)
    assert one.first().row_count == 0
    shutil.rmtree(root)
    got = {r.feature_name: r for r in DS.dataset_profile(spark, table, "d").collect()}
    x = pdf.x.dropna()
    assert got["x"].row_count == 5000 and got["x"].null_count == 5000 - len(x)
    assert math.isclose(got["x"].mean, x.mean(), rel_tol=1e-12) and math.isclose(got["x"].std, x.std(), rel_tol=1e-9)
    assert (got["x"].min, got["x"].max) == (x.min(), x.max())
    assert abs(got["k"].unique_estimate - 5000) < 200 and got["c"].unique_estimate == 3
    assert got["k"].sample_values == ["0", "1", "2", "3", "4"] and got["c"].sample_values == ["u", "v", "w"]
    assert abs((x <= got["x"].quantiles[0]).mean() - 0.5) < 0.02 and got["c"].quantiles is None
    part = {r.feature_name: r for r in DS.dataset_profile(spark, table, "d", ["v1", "v2"]).collect()}
    assert part["k"].row_count == 2000 and part["k"].sample_values[:2] == ["1", "2"]
    empty = {r.feature_name: r for r in DS.dataset_profile(spark, table, "d", ["v9"]).collect()}
    assert (empty["x"].row_count, empty["x"].mean, empty["x"].std, empty["x"].quantiles, empty["k"].sample_values) == (0, None, None, None, [])


def test_profile_written_twice_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    table = str(tmp_path / "p")
    DS.write_dataset_version(df, str(tmp_path / "a"), "d", "v1", profile_table=table)
    DS.write_dataset_version(df, str(tmp_path / "b"), "d", "v1", profile_table=table)
    assert DS.dataset_profile(spark, table, "d").first().row_count == 2


# ---------------------------------------------------------------- D8


def test_report_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("r1", 0.5, ["a"]), ("r2", None, [])], "report_id string, score double, drifted array<string>")
    with pytest.raises(FileNotFoundError):
        DS.read_reports(spark, path)
    assert DS.append_reports(rows, path, "run-1") and not DS.append_reports(rows.limit(1), path, "run-1")
    # a run that broke off is not seen, and is replaced when it runs again
    rows.limit(1).write.parquet(f"{path}/runs/run_id=run-2")
    assert DS.read_reports(spark, path).count() == 2
    assert DS.append_reports(rows, path, "run-2")
    assert {tuple(r) for r in DS.read_reports(spark, path).groupBy("run_id").count().collect()} == {("run-1", 2), ("run-2", 2)}
    with pytest.raises(ValueError):
        DS.append_reports(rows, path, "../x")


# ---------------------------------------------------------------- A6


def test_medians_by_ranks(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": r.normal(size=501), "b": r.integers(0, 5, 501).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("n", F.lit(None).cast("double")).repartition(5)
    out = P.validate_statistics(df, {"a": {"median": (-1, 1), "mean": (-1, 1)}, "b": {"median": float(pdf.b.median())}, "n": {"median": (0, 1)}})
    assert "percentile" not in out._jdf.queryExecution().analyzed().toString()
    got = {(r.column_name, r.statistic): (r.actual, r.passed) for r in out.collect()}
    assert got["a", "median"] == (pytest.approx(pdf.a.median()), True) and got["b", "median"] == (pdf.b.median(), True)
    assert got["n", "median"] == (None, False) and got["a", "mean"][1]


# ---------------------------------------------------------------- ST6, ST8


def log(seed=3, n=900):
    r = np.random.default_rng(seed)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(r.integers(0, 3600, n)), unit="s")
    minute = t.minute
    error = r.random(n) < np.where((minute >= 10) & (minute < 25) | (minute >= 40) & (minute < 48), 0.5, 0.01)
    return pd.DataFrame({"model_name": r.choice(["hot", "cold", "rare"], n, p=[0.8, 0.19, 0.01]), "prediction_id": np.arange(n), "timestamp": t,
                         "actual": r.integers(0, 2, n), "prediction": r.integers(0, 2, n), "status": np.where(error, "error", "success")})


SCHEMA = "model_name string, prediction_id long, timestamp timestamp, actual int, prediction int, status string"


def stream_of(spark, pdf, path, batches):
    """The log as a stream of so many files, one a trigger, in the order of time."""
    for i, rows in enumerate(np.array_split(np.arange(len(pdf)), batches)):
        spark.createDataFrame(pdf.iloc[rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("batches", [1, 5])
def test_rolling_accuracy_in_sub_buffers(spark, tmp_path, batches):
    pdf = log()
    out = SIO.run_available_now(MON.rolling_accuracy(stream_of(spark, pdf, str(tmp_path / "s"), batches), 100, salts=4), f"rolling-{batches}").toPandas()
    last = out.sort_values(["model_name", "last_ts", "buffered"]).groupby("model_name").last()
    for model, rows in pdf.groupby("model_name"):
        newest = rows.sort_values(["timestamp", "prediction_id"]).tail(100)
        assert last.loc[model, "buffered"] == len(newest)
        assert math.isclose(last.loc[model, "rolling_accuracy"], (newest.actual == newest.prediction).mean())
        assert last.loc[model, "last_ts"] == newest.timestamp.max()


def test_buffer_is_bounded():
    """A key's state holds twice the buffer at most, and passes on only what is new in it."""
    held = []

    class List:
        def get(self):
            return iter(held)

        def exists(self):
            return bool(held)

        def put(self, rows):
            held[:] = rows

        def appendValue(self, row):  # noqa: N802
            held.append(row)

    b = MON._SubBuffer(50)
    b.chunks = List()
    r = np.random.default_rng(0)
    seen = []
    for batch in range(30):
        n = int(r.integers(1, 200))
        ts, ids = r.integers(0, 1000, n), r.integers(0, 10**6, n)
        seen += list(zip(ts.tolist(), ids.tolist(), strict=True))
        pdf = pd.DataFrame({"ts_us": [ts.tolist()], "ids": [ids.tolist()], "correct": [[1] * n]})
        every, fresh = b.take(iter([pdf]))
        want = sorted(seen)[-50:]
        assert list(zip(every[0].tolist(), every[1].tolist(), strict=True)) == want
        assert set(zip(fresh[0].tolist(), fresh[1].tolist(), strict=True)) <= set(want)
        assert sum(len(c[0]) for c in held) <= 100


def brute_alerts(pdf, threshold, hold, span, delay_s):
    out = []
    final = int((pdf.timestamp.max().value // 10**6 - delay_s * 1000) // 60_000) - 1
    minute = pdf.timestamp.astype("datetime64[us]").astype("int64") // 60_000_000
    for model, rows in pdf.groupby("model_name"):
        m, e = minute[rows.index].to_numpy(), (rows.status == "error").to_numpy()
        run = start = 0
        for t in range(m.min(), final + 1):
            now = (m > t - span) & (m <= t)
            if now.any() and 100.0 * e[now].sum() / now.sum() > threshold:
                start = t if run == 0 else start
                run += 1
                if run == hold:
                    out.append((model, pd.Timestamp(start * 60, unit="s"), pd.Timestamp(t * 60, unit="s"), run, round(100.0 * e[now].sum() / now.sum(), 6)))
            else:
                run = 0
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_alerts_see_a_row_a_minute(spark, tmp_path, batches):
    """The same alerts for any number of batches, as by brute force."""
    pdf = log(5)
    out = SIO.run_available_now(MON.held_alerts(stream_of(spark, pdf, str(tmp_path / "s"), batches), 20.0, 4), f"alerts-{batches}").collect()
    want = brute_alerts(pdf, 20.0, 4, 5, 120)
    assert sorted((r.model_name, pd.Timestamp(r.alert_start), pd.Timestamp(r.alert_minute), r.minutes_held, round(r.error_rate, 6)) for r in out) == want
    assert len(want) >= 3
