"""Column expressions for feature transforms, ids and hashes.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p(x: Column) -> Column:
    """log(1 + x); NULL for x <= -1 (Spark's rule; the reference gives NaN / -inf)."""
    return F.log1p(x.cast("double"))


def sqrt(x: Column) -> Column:
    """Square root; negative input is missing (NULL), not NaN."""
    x = x.cast("double")
    return F.when(x >= 0, F.sqrt(x))


def square(x: Column) -> Column:
    """x², computed in double so integer inputs cannot overflow."""
    x = x.cast("double")
    return x * x


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def as_timestamp(x: Column, fmt: str | None = None) -> Column:
    """Timestamps pass through; strings are parsed (ISO by default)."""
    return F.to_timestamp(x, fmt) if fmt else F.to_timestamp(x)


# Datetime components a feature can request.
DATETIME_COMPONENTS = ("year", "month", "day", "dayofweek", "hour")
DEFAULT_DATETIME_COMPONENTS = ("year", "month", "day", "dayofweek")


def datetime_part(ts: Column, component: str) -> Column:
    """year / month / day / dayofweek (Monday = 0) / hour."""
    if component == "year":
        return F.year(ts)
    if component == "month":
        return F.month(ts)
    if component == "day":
        return F.dayofmonth(ts)
    if component == "dayofweek":
        return F.weekday(ts)  # Monday 0 … Sunday 6 (F.dayofweek is Sunday 1)
    if component == "hour":
        return F.hour(ts)
    raise ValueError(f"unknown datetime component {component!r}")


def datetime_parts(ts: Column, prefix: str, components: Sequence[str] = DEFAULT_DATETIME_COMPONENTS) -> dict:
    """``{prefix_component: expr}`` for ``withColumns``."""
    return {f"{prefix}_{c}": datetime_part(ts, c) for c in components}


def bin_code(x: Column, edges: Column, max_edges: int) -> Column:
    """Right-closed quantile bin, lowest edge included, 0-based.

    ``edges`` are sorted distinct edges (at most ``max_edges``); the code is the
    number of inner edges strictly below x.  Written as a fixed-width sum rather
    than a lambda so ``edges`` may be a scalar subquery.  Fewer than two edges →
    NULL for every row; NULL x stays NULL.
    """
    n = F.size(edges)
    xd = x.cast("double")
    terms = [F.when((F.lit(i) < n) & (F.try_element_at(edges, F.lit(i)) < xd), 1).otherwise(0)
             for i in range(2, max(max_edges, 2))]
    code = sum(terms[1:], terms[0]) if terms else F.lit(0)
    return F.when(x.isNotNull() & (n >= 2), code.cast("int"))


def onehot(x: Column, categories: Sequence[str]) -> Column:
    """0/1 array over the sorted categories; NULL → 'missing'; unknown → all zeros."""
    v = F.coalesce(x.cast("string"), F.lit("missing"))
    return F.array(*[(v == F.lit(c)).cast("int") for c in categories])


def features_hash(features_json: Column) -> Column:
    """md5 of a features document with its keys sorted (the prediction cache key)."""
    m = F.from_json(features_json, "map<string,string>")
    entries = F.array_sort(F.map_entries(m))
    return F.md5(F.to_json(F.map_from_entries(entries)))


def short_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` + 12 hex chars of sha256 over the parts: deterministic ids."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]),
                                                          256), 1, 12))


def version_stamp(ts: Column) -> Column:
    """Dataset version text ``vYYYYMMDD_HHMMSS``."""
    return F.date_format(ts, "'v'yyyyMMdd_HHmmss")


def uniform(seed: int, *keys: Column) -> Column:
    """Deterministic U[0,1) from row keys: the same value whatever the partitioning."""
    h = F.xxhash64(*keys, F.lit(seed))
    return (F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53))
