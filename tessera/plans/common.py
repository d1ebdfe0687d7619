"""Registry of named queries: each pairs a Spark plan with its DuckDB oracle SQL.

A query takes ``(spark, sf_dir)`` and returns a DataFrame over the driver tables.
Doubles are rounded to 6 places on both sides so that the two engines' summation
orders do not show in the comparison; counts are bigint on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import load

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with its oracle SQL (None = rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def r6(c: Column | str, places: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places)


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (oracle-facing projection)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def joined(c: Column | str, sep: str = ",") -> Column:
    """Array → delimited string, for oracle-facing output."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)
