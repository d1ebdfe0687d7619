"""Database source (S3): any SQL query over a JDBC connection string.

Parallel reads split a numeric column into ``num_partitions`` ranges, so each
task pulls one slice; without bounds the read is a single task, which is only
right for small queries.  (Not exercised by the registered queries: that would
need a running database.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
              properties: dict | None = None, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int | None = None, fetch_size: int = 10_000) -> DataFrame:
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partitioned reads need lower_bound, upper_bound and num_partitions")
        source = table if table is not None else f"({query}) q"
        r = (r.option("dbtable", source).option("partitionColumn", partition_column)
             .option("lowerBound", lower_bound).option("upperBound", upper_bound)
             .option("numPartitions", num_partitions))
    elif query is not None:
        r = r.option("query", query)
    else:
        r = r.option("dbtable", table)
    return r.load()
