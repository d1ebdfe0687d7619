"""Stream sources and sinks.

Sinks are files in the shared folder (Parquet file sink or ``foreachBatch``
appends), each with its own checkpoint location there, so a restarted query --
or one whose executors were lost -- resumes exactly where it stopped.  The
memory sink is not used: it would hold the results in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need ``timestamp``: cast the loaded ``timestamp_ntz`` (wall clock, session zone)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def read_table_stream(spark: SparkSession, directory: str, file_glob: str, schema: str = EVENTS_SCHEMA,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of one table as a stream (``pathGlobFilter`` picks the table's files)."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available into a Parquet sink, then read it back."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    ckpt = scratch_path(spark, f"stream-{name}-checkpoint")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def foreach_batch_append(stream: DataFrame, path: str, name: str, partition_by: list[str] | None = None
                         ) -> DataFrame:
    """``foreachBatch`` append that is idempotent per batch id (ST7).

    Each micro-batch is written under ``batch_id=<n>``, overwriting that one
    directory only (dynamic partition overwrite): a batch replayed after a failure
    replaces its own earlier partial output instead of duplicating it.
    """
    spark = stream.sparkSession
    ckpt = scratch_path(spark, f"sink-{name}-checkpoint")

    def write(batch: DataFrame, batch_id: int):
        (batch.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", *(partition_by or [])).parquet(path))

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)
