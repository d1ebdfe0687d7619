"""Operator 4: nearest neighbours by adaptive scans over dimension blocks.

*Index.*  Cell centres are fitted on a bounded sample (`SAMPLE` vectors, the least by a
seeded hash of the id); every vector is put into the cell of its nearest centre, and the
vectors of a cell are kept in blocks of `BLOCK` at most.  A block holds the vectors after
a random rotation, cut into column blocks of `COLUMNS` dimensions, next to the originals.

*Probes.*  How many cells a query must probe is read off the sample too: the rank, among
the cells by nearness, below which lie `REACH` of the sample vectors' true neighbours.
Clustered data need few cells, spread-out data need many.

*Scan.*  Within each probed list the distances grow column block by column block.  After
d of D rotated dimensions a partial squared distance s estimates the whole as s * D / d;
a candidate is abandoned if even s > r * d/D * (1 + EPSILON / sqrt(d))**2, where r is the
query's tenth best squared distance so far: a test that rejects a true neighbour with a
small probability only.  Every query searches the list of its nearest cell first; the tenth
distance found there goes with it to its other lists, which then give what is nearer, and
nothing else.  Within a block the first rows, and the blocks that the task has scanned
before, may set a smaller r.  To r the rounding of the partial distances is added, which
grows with the squared norms.  Candidates that stay to the end are measured on the original
vectors in doubles.

Queries move to the lists in blocks as well, and every pair of a query block and a list
block is one row of a join on the cell, so a cell with a third of all vectors is many
rows, which adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import shared_folder
from tessera.llm.repeats import table_of
from tessera.llm.vec_dedup import clean, matrix

#: The sample for centres and probes: a fixed bound, whatever the number of vectors.
SAMPLE, CELLS, ROUNDS, REACH = 8192, 64, 10, 0.985
BLOCK, QUERY_BLOCK, COLUMNS, EPSILON = 2048, 256, 16, 2.1
#: Rounding of a partial squared distance, as a share of both squared norms; queries whose bounds a task remembers.
ROUNDING, REMEMBERED = 4e-6, 1 << 20


def fit(x: np.ndarray, cells: int, k: int, reach: float) -> tuple[np.ndarray, int]:
    """Centres, and the number of cells to probe."""
    r = np.random.Generator(np.random.PCG64(404))
    c = np.unique(x, axis=0)
    c = c[r.permutation(len(c))[:cells]]
    for _ in range(ROUNDS):
        cell = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        for j in np.unique(cell):
            c[j] = x[cell == j].mean(0)
    near = (c**2).sum(1) - 2 * x @ c.T
    cell = np.argmin(near, axis=1)
    rank = np.argsort(np.argsort(near, axis=1, kind="stable"), axis=1)
    ranks: list[np.ndarray] = []
    for i in range(0, min(len(x), 1024)):
        d = (x**2).sum(1) - 2 * x @ x[i]
        d[i] = np.inf
        best = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        ranks.append(rank[i, cell[best]])
    flat = np.concatenate(ranks) if ranks else np.zeros(0, dtype=int)
    return c, int(np.quantile(flat, reach, method="higher")) + 1 if len(flat) else len(c)


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(40)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def index_blocks(batches, turn: np.ndarray):
    """Rows (cell, id, v), sorted by cell, as blocks (cell, ids, originals, rotated column blocks)."""
    d = len(turn)
    for b in batches:
        if not b.num_rows:
            continue
        cell, ids, x = b.column("cell").to_numpy(), b.column("id").to_numpy(), matrix(b.column("v"))
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        cut = [(i, min(i + BLOCK, hi)) for lo, hi in zip(edge[:-1], edge[1:], strict=True) for i in range(lo, hi, BLOCK)]
        turned = [(x[lo:hi] @ turn).astype(np.float32) for lo, hi in cut]
        yield table_of(
            cell=np.array([cell[lo] for lo, _ in cut]), ids=binary([ids[lo:hi] for lo, hi in cut]), vectors=binary([x[lo:hi] for lo, hi in cut]),
            columns=binary([np.concatenate([t[:, s : s + COLUMNS].ravel() for s in range(0, d, COLUMNS)]) for t in turned]),
        )


def query_blocks(batches):
    """Rows (cell, id, v, far), sorted by cell, as blocks (cell, queries, qv, far)."""
    for b in batches:
        if not b.num_rows:
            continue
        cell, ids, x, far = b.column("cell").to_numpy(), b.column("id").to_numpy(), matrix(b.column("v")), b.column("far").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        cut = [(i, min(i + QUERY_BLOCK, hi)) for lo, hi in zip(edge[:-1], edge[1:], strict=True) for i in range(lo, hi, QUERY_BLOCK)]
        yield table_of(cell=np.array([cell[lo] for lo, _ in cut]), queries=binary([ids[lo:hi] for lo, hi in cut]), qv=binary([x[lo:hi] for lo, hi in cut]), far=binary([far[lo:hi] for lo, hi in cut]))


def first_of_id(ids: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a row is the first one of its id within its group."""
    order = np.lexsort((np.arange(len(ids)), ids, group))
    out = np.ones(len(ids), dtype=bool)
    out[order[1:]] = (ids[order[1:]] != ids[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
    return out


def scan(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, columns: np.ndarray, turn: np.ndarray, k: int, known: np.ndarray | None = None):
    """(query, id, distance) of each query's `k` nearest ids of this block, none farther than `known`, a distance
    within which each query has `k` of them."""
    n, d = x.shape
    parts, at = [], 0
    for s in range(0, d, COLUMNS):
        w = min(COLUMNS, d - s)
        parts.append(columns[at : at + n * w].reshape(n, w))
        at += n * w
    turned = (q @ turn).astype(np.float32)
    lead = min(n, 8 * k)
    above = np.float32(1 + 1e-5)
    bound = np.full(len(q), np.inf, dtype=np.float32) if known is None else (known**2).astype(np.float32) * above
    repeated = len(np.unique(ids)) < n
    for i in range(len(q)):  # the first rows of the block set the bound
        s = ((x[:lead] - q[i]) ** 2).sum(1)
        s = s[ids[:lead] != qid[i]]
        if repeated:
            own = ids[:lead][ids[:lead] != qid[i]]
            s = np.sort(s)[first_of_id(own[np.argsort(s, kind="stable")], np.zeros(len(s)))]
        if len(s) >= k:
            bound[i] = min(bound[i], np.partition(s, k - 1)[k - 1] * above)
    qi, xi = np.divmod(np.arange(len(q) * n), n)
    part = np.zeros(len(qi), dtype=np.float32)
    loose_q, loose_x = (((v**2).sum(1) * ROUNDING).astype(np.float32) for v in (q, x))
    done = 0
    for s, p in zip(range(0, d, COLUMNS), parts, strict=True):
        w = p.shape[1]
        if done == 0:
            a = turned[:, :w]
            part = np.maximum((a**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * a @ p.T, 0).ravel()
        else:
            for c in range(0, len(qi), 1 << 17):
                z = slice(c, c + (1 << 17))
                part[z] += ((turned[qi[z], s : s + w] - p[xi[z]]) ** 2).sum(1)
        done += w
        limit = bound * np.float32(done / d * (1 + (EPSILON / np.sqrt(done) if done < d else 0)) ** 2) + loose_q
        stay = part <= limit[qi] + loose_x[xi]
        qi, xi, part = qi[stay], xi[stay], part[stay]
    own = ids[xi] == qid[qi]
    qi, xi = qi[~own], xi[~own]
    dist = np.sqrt(((q[qi] - x[xi]) ** 2).sum(1))
    order = np.lexsort((ids[xi], dist, qi))
    if repeated:
        order = order[first_of_id(ids[xi[order]], qi[order])]
    if known is not None:
        order = order[dist[order] <= known[qi[order]]]
    qi, xi, dist = qi[order], xi[order], dist[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
    top = rank < k
    return qid[qi[top]], ids[xi[top]], dist[top]


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, sample: int = SAMPLE, cells: int = CELLS, reach: float = REACH, probes: int | None = None) -> DataFrame:
    """For each row of `queries` the `k` nearest rows found in `vectors` by Euclidean distance
    (in doubles, on the original vectors), other than rows with the query's own id: query_id,
    rank (from 1), vec_id, score; nearest first, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    NULL id, take no part; nor do vectors of another length than most of the sample's.  Rows
    that share an id count once, by the nearest.  Fewer than `k` candidates give fewer rows;
    empty tables give none.  `probes` overrides the number of cells read off the sample.
    """
    def rows(df: DataFrame) -> DataFrame:
        df = clean(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("e")), "e")
        return df.where("v is not null and id is not null").select("id", "v")

    spark = vectors.sparkSession
    every, asked = rows(vectors), rows(queries)
    got = every.select("v").orderBy(F.xxhash64("id", F.lit(4)), "id").limit(sample).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not got:
        return spark.createDataFrame([], schema)
    lengths = np.array([len(r.v) for r in got])
    d = int(np.bincount(lengths).argmax())
    centres, reached = fit(np.array([r.v for r in got if len(r.v) == d]), cells, k, reach)
    probes = min(probes or reached, len(centres))
    turn = rotation(d)
    half = (centres**2).sum(1)

    def assign(batches, most: int):
        for b in batches:
            if b.num_rows:
                near = half - 2 * matrix(b.column("v")) @ centres.T
                pick = np.argmin(near, axis=1)[:, None] if most == 1 else np.argsort(near, axis=1, kind="stable")[:, :most]
                rep = pa.array(np.repeat(np.arange(b.num_rows), pick.shape[1]))
                yield table_of(cell=pick.ravel(), id=b.column("id").take(rep), v=b.column("v").take(rep), nth=np.tile(np.arange(pick.shape[1]), b.num_rows))

    kind = "cell long, id long, v array<double>, nth long"
    every, asked = every.where(F.size("v") == d), asked.where(F.size("v") == d)
    salt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    lists = every.mapInArrow(lambda b: assign(b, 1), kind).select("cell", "id", "v").repartition("cell", salt(64)).sortWithinPartitions("cell", "id").mapInArrow(lambda b: index_blocks(b, turn), "cell long, ids binary, vectors binary, columns binary")
    probed = asked.mapInArrow(lambda b: assign(b, probes), kind)

    def search(batches):
        bounds: dict[int, float] = {}
        for b in batches:
            for r in range(b.num_rows):
                raw = {c: b.column(c)[r].as_buffer() for c in ("ids", "vectors", "columns", "queries", "qv", "far")}
                x, q = (np.frombuffer(raw[c], dtype=np.float64).reshape(-1, d) for c in ("vectors", "qv"))
                ids, qid = (np.frombuffer(raw[c], dtype=np.int64) for c in ("ids", "queries"))
                columns, far = np.frombuffer(raw["columns"], dtype=np.float32), np.frombuffer(raw["far"])
                known = np.minimum(far, [bounds.get(i, np.inf) for i in qid.tolist()])
                a, v, s = scan(q, qid, x, ids, columns, turn, k, known)
                last = np.flatnonzero(np.append(a[1:] != a[:-1], True)) if len(a) else np.zeros(0, dtype=int)
                full = last[np.diff(last, prepend=-1) >= k]
                if len(bounds) > REMEMBERED:
                    bounds.clear()
                for i, limit in zip(a[full].tolist(), s[full].tolist(), strict=True):
                    bounds[i] = min(limit, bounds.get(i, np.inf))
                yield table_of(query_id=a, vec_id=v, score=s)

    def found_in(rows: DataFrame) -> DataFrame:
        """What queries (cell, id, v, far) find in their lists, each id once."""
        blocks = rows.repartition("cell", salt(8)).sortWithinPartitions("cell", "id").mapInArrow(query_blocks, "cell long, queries binary, qv binary, far binary")
        out = lists.join(blocks, "cell").mapInArrow(search, "query_id long, vec_id long, score double")
        return out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    def ranked(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k)

    nowhere = F.lit(float("inf"))
    first = ranked(found_in(probed.where("nth = 0").select("cell", "id", "v", nowhere.alias("far"))))
    # both phases and the bounds between them read it: at most `k` rows a query
    shared_folder(vectors)
    first = first.checkpoint()
    far = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("far"))
    rest = probed.where("nth > 0").join(far, "id", "left").select("cell", "id", "v", F.coalesce("far", nowhere).alias("far"))
    every = first.drop("rank").unionByName(found_in(rest)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return ranked(every).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's rows for `embeddings`: queries are the ids divisible by 100."""
    v = vectors.select("vec_id", "embedding")
    return nearest(v, v.where(F.col("vec_id") % 100 == 0))
