"""Versioned datasets, checksums, the prediction log and metadata tables.

A dataset version is an immutable Parquet (or CSV) directory under
``<root>/<name>/<version>/``; its metadata row is appended to a
``dataset_metadata`` table.  The row count and size come from the written
files (Parquet footers and file metadata), not from a second pass over the data.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from typing import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA_SCHEMA = T.StructType([
    T.StructField("ingestion_id", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.LongType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("checksum", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("validation_passed", T.BooleanType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("deleted", T.BooleanType()),
])


def version_stamp(now: datetime | None = None) -> str:
    """``vYYYYMMDD_HHMMSS`` (UTC)."""
    now = now or datetime.now(timezone.utc)
    return now.strftime("v%Y%m%d_%H%M%S")


def dataset_path(root: str, name: str, version: str) -> str:
    return f"{root.rstrip('/')}/{name}/{version}"


def checksum(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint (S8): 16 hex chars of sha256 over
    ``count | sum(xxhash64(row)) | bit_xor(xxhash64(row))``.

    Both aggregates are commutative and combine per partition, so the value does
    not depend on row order or partitioning (unlike hashing a CSV dump).
    """
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"),
                 F.bit_xor(h).alias("x"))
    return agg.select(F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"),
                                                     F.col("x").cast("string")), 256), 1, 16).alias("checksum"))


def write_dataset_version(df: DataFrame, root: str, name: str, version: str | None = None, fmt: str = "parquet",
                          tags: Mapping[str, str] | None = None, source_type: str = "dataframe",
                          source_path: str = "", validation_passed: bool | None = None,
                          metadata_table: str | None = None, profile_table: str | None = None) -> DataFrame:
    """Write one immutable version and return (and optionally append) its metadata row.

    With ``profile_table``, the version's profile (mergeable summaries per column) is appended
    there, so that the profile of any set of versions needs no rows of them (``dataset_profile``).
    """
    spark = df.sparkSession
    version = version or version_stamp()
    path = dataset_path(root, name, version)
    w = df.write.mode("errorifexists")
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt}")
    written = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)
    stats = written.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"),
                           F.lit(1).alias("one")) \
        .groupBy("p", "s").agg(F.count("one").alias("n")) \
        .agg(F.coalesce(F.sum("s"), F.lit(0)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    rows, size = stats["rows"], stats["size"]
    # of what lies in the files, not of a second run of the source
    stored = written if fmt == "parquet" else spark.read.option("header", True).schema(df.schema).csv(path)
    digest = checksum(stored).first()["checksum"]
    now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    meta = spark.createDataFrame([(f"{name}:{version}", name, version, int(rows), len(df.columns), int(size),
                                   list(df.columns), digest, source_type, source_path, validation_passed,
                                   dict(tags or {}), now, False)], METADATA_SCHEMA)
    if profile_table:
        from tessera.operators.sketches import profile

        profile(stored).select(F.lit(name).alias("dataset_name"), F.lit(version).alias("version"), "*").write.mode("append").parquet(profile_table)
    if metadata_table:
        meta.write.mode("append").parquet(metadata_table)
    return meta


def dataset_profile(spark: SparkSession, profile_table: str, name: str, versions: Sequence[str] | None = None) -> DataFrame:
    """Statistics over the rows of all (or the given) versions of a dataset, from their stored profiles alone.  A
    version whose profile was written twice counts once."""
    from tessera.operators.sketches import describe_profile, merge_profiles

    rows = spark.read.parquet(profile_table).where(F.col("dataset_name") == name)
    if versions is not None:
        rows = rows.where(F.col("version").isin(list(versions)))
    return describe_profile(merge_profiles(rows.dropDuplicates(["version", "column_name"]).drop("dataset_name", "version")))


# ---------------------------------------------------------------- D8 report log

def append_reports(reports: DataFrame, path: str, run_id: str) -> bool:
    """Append a run's report rows to the log at ``path``, once: whether they were written now.

    The rows go to the run's own folder, replacing what a run that broke off has left there;
    then the run's commit marker is created, which fails if another writer of the same run was
    faster.  ``read_reports`` sees runs with a marker only, whole or not at all.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run id {run_id!r} has other characters than letters, digits, '_', '.' and '-'")
    spark = reports.sparkSession
    base = path.rstrip("/")
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/committed/{run_id}")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(marker):
        return False
    reports.write.mode("overwrite").parquet(f"{base}/runs/run_id={run_id}")
    fs.mkdirs(marker.getParent())
    try:
        out = fs.create(marker, False)
    except Py4JJavaError:
        if fs.exists(marker):
            return False
        raise
    out.writeBytes(run_id)  # readers list files that hold something
    out.close()
    return True


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed runs, with ``run_id``.  A log without committed runs raises FileNotFoundError."""
    base = path.rstrip("/")
    committed = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/committed")
    if not committed.getFileSystem(spark._jsc.hadoopConfiguration()).exists(committed):
        raise FileNotFoundError(path)
    markers = spark.read.format("binaryFile").load(f"{base}/committed").select(F.element_at(F.split("path", "/"), -1).alias("run_id"))
    rows = spark.read.option("basePath", f"{base}/runs").schema(f"{_ddl(spark, base)}, run_id string").parquet(f"{base}/runs")
    return rows.join(markers, "run_id", "left_semi")


def _ddl(spark: SparkSession, base: str) -> str:
    fields = spark.read.parquet(f"{base}/runs").drop("run_id").schema.fields
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def read_dataset_version(spark: SparkSession, root: str, name: str, version: str | None = None,
                         metadata_table: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read by name+version; without a version, the newest live one from the metadata table."""
    if version is None:
        if metadata_table is None:
            raise ValueError("latest version needs the metadata table")
        meta = spark.read.parquet(metadata_table).where((F.col("dataset_name") == name) & ~F.col("deleted"))
        latest = meta.agg(F.max_by("version", F.struct("created_at", "version")).alias("v")).first()["v"]
        if latest is None:
            raise FileNotFoundError(name)
        version = latest
    path = dataset_path(root, name, version)
    return spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)


def prediction_log_append(preds: DataFrame, path: str, files_per_partition: int = 8) -> None:
    """Append predictions, stamping ``created_at`` and partitioning by model and day.

    Later scans that filter on model and date prune whole directories.  A model's day
    is written as ``files_per_partition`` files at most, by as many tasks.
    """
    out = (preds.withColumn("created_at", F.coalesce(F.col("created_at"), F.localtimestamp())
                            if "created_at" in preds.columns else F.localtimestamp())
           .withColumn("log_date", F.to_date("timestamp")))
    # one writer for each model and day and salt, not a file from every task for each
    salt = F.pmod(F.xxhash64("prediction_id"), F.lit(files_per_partition))
    out.repartition("model_name", "log_date", salt).write.mode("append").partitionBy("model_name", "log_date").parquet(path)


def metadata_append(rows: DataFrame, path: str) -> None:
    """Insert records into a metadata table (Parquet, append-only)."""
    rows.write.mode("append").parquet(path)
