"""Ordered statistics without a single-task global sort.

``prefix_sums`` is the two-phase running sum behind ECDFs (KS), ROC AUC, exact
quantiles and row ranks:

1. range-partition the (already pre-aggregated) rows on ``keys + order`` and sort
   within partitions -- one shuffle, balanced by sampled range bounds, so a key
   holding a third of the rows spreads over many tasks.  The result is
   checkpointed (reliable, to the shared checkpoint folder): range bounds come
   from a random sample, so two evaluations could partition differently, and
   both later phases must see the same partitions.  The checkpoint also cuts the
   lineage, so a lost executor does not recompute the shuffle;
2. per partition, a vectorised running sum (``mapInPandas`` over Arrow batches,
   streaming: no partition is materialised in memory);
3. per-(partition, key) totals -- at most ``partitions + keys`` rows -- turned
   into offsets by a window over that small table and joined back (AQE
   broadcasts it when it is small, otherwise it is a shuffle join).

A plain ``Window.orderBy`` without ``partitionBy`` would put every row into one
task instead.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_dir

PID = "__pid"


def _same_key(a: tuple, b: tuple) -> bool:
    """Equal keys, where NULL equals NULL."""
    return all((x == y) or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True))


def _local_cumsum(keys: list[str], values: list[str]):
    """Running sums inside one sorted partition, carried across Arrow batches."""

    def run(batches):
        carry_key, carry = None, np.zeros(len(values))
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{f"cum_{v}": pd.Series(dtype="float64") for v in values})
                continue
            kv = pdf[[PID] + keys]
            before = kv.shift()
            new_group = ((kv != before) & ~(kv.isna() & before.isna())).any(axis=1).to_numpy()
            continues = carry_key is not None and _same_key(tuple(kv.iloc[0]), carry_key)
            new_group[0] = True
            gid = np.cumsum(new_group)
            out = {}
            for j, v in enumerate(values):
                x = pdf[v].fillna(0).to_numpy(dtype="float64")
                cs = pd.Series(x).groupby(gid).cumsum().to_numpy()
                if continues:
                    cs = cs + np.where(gid == 1, carry[j], 0.0)
                out[f"cum_{v}"] = cs
            carry = np.array([out[f"cum_{v}"][-1] for v in values])
            carry_key = tuple(kv.iloc[-1])
            yield pdf.assign(**out)

    return run


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    values: Sequence[str],
    num_partitions: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """Inclusive running sums ``cum_<v>`` of ``values`` over ``order`` within ``keys``,
    plus ``total_<v>``, the sum over the whole key.

    ``order`` is one column or a list (lexicographic).  A NULL key is a key of its own.  ``df`` should hold one row
    per (keys, order) -- pre-aggregate first, so the shuffle moves distinct
    values, not raw rows.  Sums are doubles.  Key totals come from the small
    per-partition table, so callers need no second pass over the ranked rows.
    ``materialize=True`` checkpoints the result too, for callers that read it
    several times (the Python running sum then runs once).
    """
    keys, values = list(keys), list(values)
    order = [order] if isinstance(order, str) else list(order)
    spark = df.sparkSession
    checkpoint_dir(spark)
    # without a count adaptive execution sizes the partitions
    ranged = (df.repartitionByRange(*([num_partitions] if num_partitions else []), *keys, *order)
              .sortWithinPartitions(*keys, *order)
              .checkpoint(eager=True)
              .withColumn(PID, F.spark_partition_id()))
    out_schema = T.StructType(list(ranged.schema.fields)
                              + [T.StructField(f"cum_{v}", T.DoubleType()) for v in values])
    local = ranged.mapInPandas(_local_cumsum(keys, values), out_schema)
    totals = ranged.groupBy(PID, *keys).agg(*[F.sum(F.col(v).cast("double")).alias(f"tot_{v}")
                                              for v in values])
    w = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(PID, *keys, *[F.coalesce(F.sum(f"tot_{v}").over(w), F.lit(0.0)).alias(f"off_{v}")
                                          for v in values],
                            *[F.sum(f"tot_{v}").over(whole).alias(f"total_{v}") for v in values])
    out = _attach(local, offsets, [PID, *keys]).select(
        *[c for c in ranged.columns if c != PID],
        *[(F.col(f"cum_{v}") + F.coalesce(F.col(f"off_{v}"), F.lit(0.0))).alias(f"cum_{v}") for v in values],
        *[F.col(f"total_{v}") for v in values],
    )
    return out.checkpoint(eager=True) if materialize else out


def _attach(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe key equality.

    ``<=>`` stops the optimizer from inferring ``isnotnull`` filters into the big
    side, which would make its subtree differ from the other branch and defeat
    exchange reuse (the range shuffle would then run twice).
    """
    s = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                     *[c for c in small.columns if c not in keys])
    cond = [big[k].eqNullSafe(s[f"__k{i}"]) for i, k in enumerate(keys)]
    return big.join(s, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def distinct_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, cnt) over non-null values: the pre-aggregation step."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("cnt")))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
) -> DataFrame:
    """Exact linear-interpolation quantiles per key: ``(keys, quantiles array<double>)``.

    Same definition as pandas ``quantile`` / Spark ``percentile``, but distributed:
    distinct values are ranked by ``prefix_sums``; every ranked row keeps only the
    target positions that fall inside its own rank interval (an array filter, no
    pairing of rows), and the interpolation is done per key on those few rows.
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    if not keys:  # one global group: a constant key keeps the plan keyed (no keyless join)
        return exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs).drop("__all")
    counts = distinct_counts(df, keys, value)
    ranked = prefix_sums(counts, keys, value, ["cnt"])
    return quantiles_from_ranked(ranked, keys, value, "cnt", "cum_cnt", "total_cnt", probs)


def quantiles_from_ranked(ranked: DataFrame, keys: Sequence[str], value: str, cnt: str, cum: str, n: str,
                          probs: Sequence[float]) -> DataFrame:
    """Quantiles from a ranked table: one row per (keys, value) with its count, the
    inclusive running count and the key total.  Only rows holding a target rank
    survive the filter, so the final grouping sees a handful of rows per key."""
    keys = list(keys)
    ranked = ranked.where(F.col(cnt) > 0)
    pos = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(p)).alias("p"),
                             F.floor((F.col(n) - 1) * F.lit(float(p))).alias("lo"),
                             F.ceil((F.col(n) - 1) * F.lit(float(p))).alias("hi")) for i, p in enumerate(probs)])
    lo_rank = F.col(cum) - F.col(cnt)
    hits = (ranked
            .withColumn("t", F.filter(pos, lambda s: ((s["lo"] >= lo_rank) & (s["lo"] < F.col(cum)))
                                      | ((s["hi"] >= lo_rank) & (s["hi"] < F.col(cum)))))
            .where(F.size("t") > 0)
            .select(*keys, F.col(n).alias("__n"), F.col(value).cast("double").alias("v"), lo_rank.alias("r0"),
                    F.col(cum).alias("__cum"), F.explode("t").alias("t")))
    v_lo = F.max(F.when((F.col("t.lo") >= F.col("r0")) & (F.col("t.lo") < F.col("__cum")), F.col("v")))
    v_hi = F.max(F.when((F.col("t.hi") >= F.col("r0")) & (F.col("t.hi") < F.col("__cum")), F.col("v")))
    per_q = hits.groupBy(*keys, F.col("t.qi").alias("qi"), F.col("t.p").alias("p"), "__n").agg(
        v_lo.alias("v_lo"), v_hi.alias("v_hi"))
    frac = (F.col("__n") - 1) * F.col("p") - F.floor((F.col("__n") - 1) * F.col("p"))
    per_q = per_q.withColumn("q", F.col("v_lo") + frac * (F.col("v_hi") - F.col("v_lo")))
    return (per_q.groupBy(*keys)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("qi", "q"))), lambda s: s["q"])
                 .alias("quantiles")))
