"""Loading tables with the NaN/NULL boundary rule.

pandas has one missing value for floats; Spark has two, and ``NaN > 3`` is true in
Spark.  Every loader maps NaN to NULL in float/double columns once, here, so that
all operators downstream see a single "missing" value.  Only float/double columns
are wrapped, so filters on keys, dates and strings still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float/double column (one projection)."""
    exprs: list[Column | str] = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            exprs.append(F.when(~F.isnan(c), c).alias(f.name))
            changed = True
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs) if changed else df


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str, normalize: bool = True) -> DataFrame:
    """Read one driver table; NaN→NULL applied unless ``normalize=False``."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return nan_to_null(df) if normalize else df
