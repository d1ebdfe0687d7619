"""Session construction and shared-folder handling.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names; we only
invent one (under the system temp dir) when it is unset, which is the test case.
Everything that must outlive a task -- checkpoints, written dataset versions,
round-trip files -- goes below that folder, never to an executor-local path.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(
    master: str | None = None,
    shuffle_partitions: int = 8,
    app_name: str = "tessera",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session configured the way every tessera job expects.

    AQE (partition coalescing + skew-join splitting) is on, the clock is UTC, Arrow
    is used for pandas transfer, the UI server is off and streaming state lives in
    RocksDB so that large keyed state spills to disk instead of the JVM heap.

    Partition sizing: scans split files at 128 MiB and AQE aims shuffle partitions
    at 128 MiB, so a partition fits an executor's memory whatever the data size.
    ``shuffle_partitions`` is the pre-coalescing upper bound: the core count on one
    machine; on a cluster about three times the total executor cores, which AQE
    then coalesces for small stages.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # checkpoint files go when the driver no longer refers to them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "8g"),
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir``; a local master without one gets a temporary folder
    (tests), any other master without one is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        # executors of a cluster can't read a folder of the driver's machine
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-scratch/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` gave, once nothing reads it any more."""
    if "/tessera-scratch/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
