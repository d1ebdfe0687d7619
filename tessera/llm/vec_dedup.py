"""Operator 9: near-duplicate vectors by cross-polytope hashing.

A vector is turned by random signs and fast Hadamard transforms (three rounds); its hash
is the signed axis it then points to most.  A table joins the hashes of `per_table`
rotations into one bucket.  A vector lies in its own bucket of each table and *probes*
those that differ in one rotation by its second or third axis, so two vectors meet in a
table if either probes the other's bucket.

Equal vectors are one entry, with its number of copies, before any of this.  Buckets
with one entry leave the job before vectors are sent anywhere.  The entries of a bucket
come together in blocks of bounded size, each block with each other, where every pair
is verified by its exact cosine.  A pair that meets in several buckets is counted in the
first of them only, which both vectors tell by themselves; so links are counted where
they are found and no list of pairs is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components, shared_folder
from tessera.llm.hashing import U64, mix
from tessera.llm.repeats import table_of

TABLES, PER_TABLE, AXES, BLOCK = 8, 2, 3, 1024


def clean(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Adds `v`: the vector in doubles; NULL where it is null, empty, zero or holds null or non-finite components."""
    c = F.col(f"`{vec_col}`").cast("array<double>")
    ok = (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    return vectors.select("*", F.when(ok, c).alias("v"))


def hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def axes(x: np.ndarray, seed: int) -> np.ndarray:
    """The `AXES` signed axes of greatest size after rotation `seed`, greatest first."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    v = np.zeros((len(x), d))
    v[:, : x.shape[1]] = x
    r = np.random.Generator(np.random.PCG64([909, seed]))
    for _ in range(3):
        v = hadamard(v * r.choice([-1.0, 1.0], d))
    top = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :AXES]
    return top * 2 + (np.take_along_axis(v, top, 1) > 0)


def buckets(x: np.ndarray, tables: int, per_table: int) -> np.ndarray:
    """(vectors, tables, 1 + probes) bucket keys; the first of each table is the vector's own."""
    out = []
    for t in range(tables):
        a = [axes(x, t * per_table + k).astype(U64) for k in range(per_table)]

        def key(pick, a=a, t=t):
            h = mix(np.full(len(x), t + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
            for k in range(per_table):
                h = mix(h ^ (a[k][:, pick[k]] + U64(1)))
            return h

        picks = [[0] * per_table] + [[i if j == k else 0 for j in range(per_table)] for k in range(per_table) for i in range(1, a[0].shape[1])]
        out.append(np.stack([key(p) for p in picks], 1))
    return np.stack(out, 1)


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return np.asarray(col.flatten()).reshape(len(col), -1)


def by_length(b: pa.RecordBatch):
    """The batch's rows, apart by the length of their vectors."""
    size = np.diff(b.column("v").offsets.to_numpy())
    for n in np.unique(size):
        yield b.take(pa.array(np.flatnonzero(size == n)))


def place(batches, tables: int, per_table: int):
    for batch in batches:
        for b in by_length(batch):
            keys = buckets(matrix(b.column("v")), tables, per_table)
            n, _, probes = keys.shape
            each = tables * probes
            idx = pa.array(np.repeat(np.arange(n), each))
            yield table_of(
                label=b.column("label").take(idx), key=keys.reshape(-1), node=b.column("node").take(idx),
                own=pa.array(np.tile(np.arange(probes) == 0, n * tables)), t=np.tile(np.repeat(np.arange(tables), probes), n),
            )


def pairs_in(v: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, same: bool):
    """Index pairs at the cosine or over it, one of them in its own bucket."""
    u = v / np.linalg.norm(v, axis=1)[:, None]
    cos = u[left] @ u[right].T
    hit = (cos >= least) & (own[left][:, None] | own[right][None, :])
    if same:
        hit &= left[:, None] < right[None, :]
    a, b = np.nonzero(hit)
    return left[a], right[b]


def first_meeting(ka: np.ndarray, kb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table, key) of the first bucket where the vectors of each pair meet."""
    table = np.full(len(ka), -1)
    key = np.zeros(len(ka), dtype=U64)
    for t in range(ka.shape[1]):
        a_in_b = (kb[:, t] == ka[:, t, :1]).any(1)
        b_in_a = (ka[:, t] == kb[:, t, :1]).any(1)
        new = (table < 0) & (a_in_b | b_in_a)
        top = np.iinfo(U64).max
        k = np.minimum(np.where(a_in_b, ka[:, t, 0], top), np.where(b_in_a, kb[:, t, 0], top))
        table[new], key[new] = t, k[new]
    return table, key


def verify(batches, least: float, tables: int, per_table: int):
    """Rows of one bucket block pair, together, sorted: (node, links counted here, least node linked with here)."""
    rest: pa.Table | None = None
    names = ("label", "key", "i", "j")

    def settle(t: pa.Table):
        cols = [t.column(x).to_numpy() for x in names]
        new = np.ones(t.num_rows + 1, dtype=bool)
        new[1:-1] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        edge = np.flatnonzero(new)
        node, copies, side, own, table = (t.column(x).to_numpy() for x in ("node", "copies", "side", "own", "t"))
        v = t.column("v").combine_chunks()
        big = edge[:-1][np.diff(edge) > 1]
        ends = dict(zip(edge[:-1], edge[1:], strict=True))
        for lo in big:
            hi = ends[lo]
            sizes = np.diff(v.offsets.to_numpy()[lo : hi + 1])
            if sizes.min() != sizes.max():
                continue  # vectors of different lengths: their buckets met by chance
            x = matrix(v.slice(lo, hi - lo))
            at = np.arange(hi - lo)
            if cols[2][lo] == cols[3][lo]:
                a, b = pairs_in(x, own[lo:hi], at, at, least, True)
            else:
                mine = side[lo:hi] == cols[2][lo]
                a, b = pairs_in(x, own[lo:hi], at[mine], at[~mine], least, False)
            ok = node[lo + a] != node[lo + b]
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            used = np.unique(np.concatenate([a, b]))
            got = buckets(x[used], tables, per_table)
            keys = np.zeros((hi - lo, *got.shape[1:]), dtype=U64)
            keys[used] = got
            links = np.zeros(hi - lo, dtype=np.int64)
            for s in range(0, len(a), 1 << 18):
                p, q = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
                ft, fk = first_meeting(keys[p], keys[q])
                here = (ft == table[lo]) & (fk.view(np.int64) == cols[1][lo])
                np.add.at(links, p[here], copies[lo + q[here]])
                np.add.at(links, q[here], copies[lo + p[here]])
            root = at.copy()
            while True:
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, b, root[a])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            yield table_of(node=node[lo + used], links=links[used], lead=node[lo + root[used]])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        same = np.ones(t.num_rows, dtype=bool)
        for x in names:
            c = t.column(x).to_numpy()
            same &= c == c[-1]
        whole = int(np.argmax(same))
        if whole:
            yield from settle(t.slice(0, whole))
        rest = t.slice(whole)
    if rest is not None and rest.num_rows:
        yield from settle(rest)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, tables: int = TABLES, per_table: int = PER_TABLE) -> DataFrame:
    """Links between vectors of one label with a cosine (in doubles) of `least` or more.

    Returns a row for every row: the columns of `vectors` (any names) in a struct `row`,
    ``n_links`` (other vectors linked directly, copies counted each), ``component_id`` (the
    least id reachable by links, itself included) and ``kept`` (it is that one).

    A vector that is null, empty, zero or holds null or non-finite components, or whose label
    or id is NULL, links with nothing: no links, and its own id.  Vectors of different
    lengths don't link.  Equal vectors of one label link.  Ids name the nodes: a repeated row
    is a copy of the other.  An empty table gives no rows.  With 8 tables of 2 rotations a
    pair at 0.93 in 64 dimensions is missed with a probability of about 5e-5; none is cut off.
    """
    shared_folder(vectors)
    label = F.col(f"`{label_col}`")
    code = F.when(label.isNotNull(), F.xxhash64(label.cast("string")))
    rows = clean(vectors.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), code.alias("label"), F.col(f"`{vec_col}`").alias("e")), "e").drop("e")
    rows = rows.withColumn("ok", F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull())
    entries = rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies")).checkpoint()

    met = entries.mapInArrow(lambda b: place(b, tables, per_table), "label long, key long, node long, own boolean, t long")
    count = met.groupBy("label", "key").agg(F.count("*").alias("n"), F.max("own").alias("home")).where("n > 1 and home").select("label", "key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    side = F.pmod(F.xxhash64("node"), "blocks").alias("side")
    dealt = (
        met.join(count, ["label", "key"]).select("*", side)
        .select("label", "key", "t", "own", "node", "side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .join(entries.select("label", "node", "copies", "v"), ["label", "node"])
        .select("label", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "t", "own", "node", "copies", "v")
        .repartition("label", "key", "i", "j").sortWithinPartitions("label", "key", "i", "j")
    )
    found = dealt.mapInArrow(lambda b: verify(b, least, tables, per_table), "node long, links long, lead long").groupBy("node", "lead").agg(F.sum("links").alias("links")).checkpoint()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select("node", "lead"))
    of = entries.join(links, "node", "left").join(joined, "node", "left").select("label", "v", F.coalesce("links", F.lit(0)).alias("links"), F.col("copies"), F.coalesce("component", "node").alias("top"))
    out = rows.join(of, ["label", "v"], "left")
    n = F.when(F.col("ok"), F.col("links") + F.col("copies") - 1).otherwise(0)
    top = F.when(F.col("ok"), F.col("top")).otherwise(F.col("id"))
    return out.select("row", n.cast("long").alias("n_links"), top.alias("component_id"), F.coalesce(top == F.col("id"), F.lit(True)).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns for `embeddings`."""
    return near_vectors(vectors.select("vec_id", "embedding", "label")).select("row.vec_id", "n_links", "component_id", "kept")
