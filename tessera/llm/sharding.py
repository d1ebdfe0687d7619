"""Operator 5: shuffling and sharding a corpus by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets by a seeded hash, so many that a
bucket fits a task's memory.  Pass 2 shuffles each bucket by Fisher-Yates with a seed of
its own, after putting it into a fixed order, so a repeated task gives the same result.
The buckets one after the other are the shuffled corpus; shards are cut from it as equal
ranges of rows (law `rows`: counts at most one apart), whatever the records' sizes,
sources or texts: hot sources and groups of copies are spread by the hash like all else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.repeats import loose

SEED = 5
#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Up to so many buckets (16 TB of text), the table of their first places is broadcast.
BROADCAST_BUCKETS = 1 << 20


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation: from the last place down, each is swapped with a random one up to it."""
    out = list(range(n))
    pick = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = pick[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, dtype=np.int64)


def shuffle_bucket(table: pa.Table, seed: int) -> pa.Table:
    order = pc.sort_indices(table, sort_keys=[("__a", "ascending"), ("__b", "ascending")])
    n = table.num_rows
    rng = np.random.Generator(np.random.PCG64([seed, table.column("__bucket")[0].as_py()]))
    table = table.take(order).take(pa.array(fisher_yates(n, rng)))
    table = table.set_column(0, "row", table.column("row").cast(loose(table.column("row").type)))
    return table.append_column("__place", pa.array(np.arange(n)))


def shuffled(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`docs` in a random order, cut into `shards` shards of rows at most one apart.

    Returns the columns of `docs` (any names) in a struct `row`, ``shard`` (from 0), ``slot``
    (the place within the shard, gapless from 0) and ``bucket``.

    Rows are told apart by id and text: fully equal rows go through one bucket and get
    different slots.  NULL ids and texts count as values of their own.  Fewer rows than
    shards leave the last shards empty; an empty table gives no rows.
    """
    i, t = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    total = docs.agg(F.sum(F.octet_length(t)).cast("long"), F.count("*")).first()
    buckets = max(1, -(-(total[0] or 0) // bucket_bytes))
    a, b = F.xxhash64(F.coalesce(i, F.lit("")), i.isNull(), F.lit(seed)), F.xxhash64(F.coalesce(t, F.lit("")), t.isNull())
    rows = docs.select(F.struct("*").alias("row"), a.alias("__a"), b.alias("__b"), F.pmod(F.xxhash64(a, b), F.lit(buckets)).alias("__bucket"))
    kind = rows.schema["row"].dataType.simpleString()

    count = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    # one row a bucket: its first place in the shuffled corpus
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = count.select(F.col("__bucket").alias("bucket"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("start"))

    if buckets <= BROADCAST_BUCKETS:  # 16 bytes a bucket; a join by shuffle would move the texts again
        start = F.broadcast(start)

    def shuffle(key, table):
        return shuffle_bucket(table, seed).select(["row", "__bucket", "__place"])

    placed = rows.groupBy("__bucket").applyInArrow(shuffle, f"row {kind}, __bucket long, __place long")
    n = total[1]
    base, more = divmod(n, shards)
    g = F.col("start") + F.col("__place")
    wide = more * (base + 1)
    shard = F.when(g < wide, F.floor(g / (base + 1))).otherwise(more + F.floor((g - wide) / max(base, 1))).cast("int")
    first = F.when(F.col("shard") <= more, F.col("shard") * (base + 1)).otherwise(F.lit(wide) + (F.col("shard") - more) * base)
    return placed.join(start, F.col("__bucket") == F.col("bucket")).select("row", "bucket", g.alias("g"), shard.alias("shard")).select("row", "shard", (F.col("g") - first).cast("long").alias("slot"), "bucket")


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Write the shards below `path`, a folder shard=N each, files in the order of the slots."""
    out = shuffled(docs, shards, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias("__shard")).withColumnRenamed("__shard", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`: 8 shards, law `rows`."""
    out = shuffled(docs.select("doc_id", "text"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return out.select("row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
