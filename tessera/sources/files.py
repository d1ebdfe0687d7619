"""File sources: CSV, Parquet, JSON, suffix dispatch, sizes and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import nan_to_null


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",",
             encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """CSV with delimiter, encoding and header.

    Pass the stored ``schema``: inference costs an extra full pass over the files.
    """
    r = spark.read.option("sep", sep).option("encoding", encoding).option("header", header)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return nan_to_null(r.csv(path))


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet; projections and filters applied later still reach the scan."""
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


# Timestamp text formats for JSON round trips (microsecond precision).
JSON_TIMESTAMP_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_json_records(df: DataFrame, path: str) -> None:
    """JSON lines, keeping microseconds of timestamps (the default writes milliseconds)."""
    df.write.option("timestampNTZFormat", JSON_TIMESTAMP_NTZ_FORMAT).json(path)


def scan_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      multiline: bool = False) -> DataFrame:
    """JSON lines (default) or one JSON array per file (``multiline``)."""
    r = spark.read.option("multiLine", multiline).option("timestampNTZFormat", JSON_TIMESTAMP_NTZ_FORMAT)
    if schema is not None:
        r = r.schema(schema)
    return nan_to_null(r.json(path))


def scan_json_columns(spark: SparkSession, path: str, columns_schema: str) -> DataFrame:
    """A JSON object of columns ``{"a": [...], "b": [...]}`` → rows (arrays_zip + inline).

    ``columns_schema`` is the DDL of the object, e.g. ``"a array<bigint>, b array<string>"``.
    """
    doc = spark.read.option("multiLine", True).schema(columns_schema).json(path)
    names = [f.name for f in doc.schema.fields]
    return doc.select(F.inline(F.arrays_zip(*[F.col(n) for n in names])))


# The formats a file suffix selects.
SUFFIX_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def scan_by_suffix(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Dispatch on the file suffix; anything else is an error."""
    low = path.lower().rstrip("/")
    for suffix, fmt in SUFFIX_FORMATS.items():
        if low.endswith(suffix):
            if fmt == "csv":
                return scan_csv(spark, path, schema)
            if fmt == "json":
                return scan_json_records(spark, path, schema)
            return scan_parquet(spark, path)
    raise ValueError(f"unsupported file type: {path}")


def dataset_size(df: DataFrame) -> DataFrame:
    """On-disk bytes of the files behind a file-based DataFrame.

    Sum of ``_metadata.file_size`` over distinct files (one aggregate; only the
    metadata column is read).
    """
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct()
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("s"), F.lit(0)).alias("size_bytes"))


def list_objects(spark: SparkSession, prefix: str, glob: str | None = None) -> DataFrame:
    """Files under a prefix with length and modification time; contents are pruned."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(prefix).select("path", "length", "modificationTime")
