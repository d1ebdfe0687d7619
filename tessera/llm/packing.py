"""Operator 2: best-fit packing of documents into bins under conflicts.

Documents become pieces of `capacity` at most; a full piece is a bin by itself, the rest
of each document is an item.  Items are dealt by a hash into packing groups of about
`GROUP` items, which are packed on their own, largest first: the bins of a group are
held in the order of their residual room, each with a bitmap of the sources and one of
the duplicate clusters it holds.  The search starts at the tightest bin that has room
and goes on to its successors until one is compatible: a bin takes at most one piece of
a source and one of a cluster.  If none is, a new bin is opened.

A hash deals a hot source or a large cluster evenly over all groups, so no task grows
with them; within a group the bitmaps part them.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeats import loose


CAPACITY = 8192
#: Items a packing group holds on average.
GROUP = 4096


def best_fit(size: list[int], source: list[int], cluster: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item (sizes up to `capacity`, largest first)."""
    order: list[tuple[int, int]] = []  # (residual, bin)
    used: list[tuple[int, int]] = []  # bitmaps of sources and clusters
    bins: list[int] = []
    offset: list[int] = []
    s_bit = {s: 1 << n for n, s in enumerate(dict.fromkeys(source))}
    c_bit = {c: 1 << n for n, c in enumerate(dict.fromkeys(cluster))}
    for n, s, c in zip(size, source, cluster, strict=True):
        sb, cb = s_bit[s], c_bit[c]
        at = bisect_left(order, (n, -1))
        while at < len(order):
            b = order[at][1]
            if not (used[b][0] & sb or used[b][1] & cb):
                break
            at += 1
        if at < len(order):
            room, b = order.pop(at)
            used[b] = (used[b][0] | sb, used[b][1] | cb)
        else:
            room, b = capacity, len(used)
            used.append((sb, cb))
        bins.append(b)
        offset.append(capacity - room)
        if room > n:
            insort(order, (room - n, b))
    return bins, offset


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, id_col: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Bins for every document, whole: a row for each piece with the columns of `docs` (any
    names) in a struct `row`, ``size`` (of the document), ``piece`` (from 0), ``start`` and
    ``length`` (of the piece within the document), ``bin`` (text: group and number) and
    ``bin_start``.

    A bin's pieces don't overlap, fill it up to `capacity` at most, and hold no two pieces of
    one source or one cluster.  A size that is NULL or not above 0 makes one piece of length
    0, which is packed like any other.  A NULL source or cluster is a value of its own, so
    give each row another cluster where none is known.  Ties go by id, then by the row's
    hash; repeated rows are packed each, and where the cluster is the same, apart.  An empty
    table gives no rows.
    """
    i = F.col(f"`{id_col}`").cast("string")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    n = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))
    code = lambda c: F.xxhash64(F.coalesce(c.cast("string"), F.lit("")), c.isNull())
    rows = docs.select(F.struct(*columns).alias("row"), n.alias("size"), code(source).alias("source"), code(cluster).alias("cluster"), F.xxhash64(F.coalesce(i, F.lit("")), i.isNull()).alias("key"))
    full = F.floor(F.col("size") / capacity)
    rest = F.when((F.col("size") > 0) & (F.col("size") % capacity == 0), full - 1).otherwise(full)
    rows = rows.select("*", rest.cast("long").alias("last"))

    groups = max(1, round(docs.count() / group))
    items = rows.withColumn("g", F.pmod(F.xxhash64("key", "cluster", F.lit(2)), F.lit(groups)))
    kind = rows.schema["row"].dataType.simpleString()

    def fill(key, table):
        last = table.column("last")
        table = table.append_column("tail", pc.subtract(table.column("size"), pc.multiply(last, capacity)))
        keys = [("tail", "descending"), ("key", "ascending"), ("cluster", "ascending"), ("source", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys))
        tail, source, cluster, last = (table.column(x).to_pylist() for x in ("tail", "source", "cluster", "last"))
        bins, offset = best_fit(tail, source, cluster, capacity)
        g = key[0].as_py()
        # the item of each document, then its full pieces, each in a bin of its own
        out = [(r, k, f"{g}-{b}", o) for r, (k, b, o) in enumerate(zip(last, bins, offset, strict=True))]
        out += [(r, k, f"{g}-{r}-{k}", 0) for r, n in enumerate(last) for k in range(n)]
        at, piece, name, start = (list(x) for x in zip(*out, strict=True))
        part = table.take(pa.array(at))
        length = [tail[r] if k == last[r] else capacity for r, k in zip(at, piece, strict=True)]
        long = lambda x: pa.array(x, pa.int64())
        return pa.table({"row": part.column("row").cast(loose(part.column("row").type)), "size": part.column("size"), "piece": long(piece), "start": long([k * capacity for k in piece]), "length": long(length), "bin": pa.array(name), "bin_start": long(start)})

    return items.groupBy("g").applyInArrow(fill, f"row {kind}, size long, piece long, start long, length long, bin string, bin_start long")


def digest(docs: DataFrame) -> DataFrame:
    """`documents` packed by their UTF-8 bytes into bins of 8,192; clusters are equal texts."""
    t = F.col("text")
    rows = docs.select("doc_id", "source", F.coalesce(F.octet_length(t), F.lit(0)).alias("n"), F.when(F.length(t) > 0, F.sha2(t, 256)).otherwise(F.concat(F.lit("empty "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("cluster"))
    out = pack(rows, F.col("n"), F.col("source"), F.col("cluster"))
    return out.select("row.doc_id", "row.source", "size", "piece", "start", "length", "bin", "bin_start")
