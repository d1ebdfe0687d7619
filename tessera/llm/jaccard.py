"""Operator 10: Jaccard join of word n-gram sets with a token-group matrix.

1. *Partition into groups of similar documents.*  Each set gets min-hash bands of four
   values, as many that a pair at the threshold meets in none with a probability of 1e-8
   at most.  Equal sets are one entry from here on.  Sets that meet in a band, directly
   or through others, form a group; the bands only say which sets may be close.  (Pure
   token unions as the only index would compare every set with every group.)
2. *Token-group matrix.*  A group's sets come together in one task, or, where a group is
   large, as blocks of bounded size, every block with every other.  There they are laid
   out in small runs of similar sets; the matrix holds which token is in the union of
   which run.
3. *Bound and open.*  J(q, x) >= t needs |q & x| >= t |q|, so a run whose union holds
   less of q is not opened; in those that are, the exact intersection decides.

A task reports only a spanning forest of the links it finds, so a dense group of copies
gives as many rows as it has sets.  All work past step 1 is on sets that met another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components, shared_folder
from tessera.llm.hashing import FIRST, PIECE, U64, byte_table, column_bytes, mix, pack_texts, row_blocks, unpacked, word_codes, word_spans
from tessera.llm.repeats import ranges, table_of

CODES = byte_table(202510, fold_case=True)
BAND = 4
#: Sets and tokens of a block, and sets of a run.
BLOCK_SETS, BLOCK_TOKENS, RUN = 256, 1 << 18, 16


def bands_for(percent: int, miss: float = 1e-8) -> int:
    """Bands so that a pair at the threshold meets in none with a probability of `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** BAND))


def shingle_sets(text: pa.Array, words: int):
    """Block by block: first row, distinct shingle hashes (sorted within each row), their offsets."""
    buf, off = column_bytes(text)
    for a, b in row_blocks(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, w = word_spans(part, o)
        sums = FIRST.sums(word_codes(part, starts, ends, CODES, FIRST))
        n = np.diff(w)
        count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
        at = ranges(w[:-1], count)
        row = np.repeat(np.arange(b - a), count)
        h = mix(FIRST.slices(sums, at, np.minimum(at + words, w[row + 1])) + np.minimum(words, n[row]).astype(U64))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        yield a, h, np.searchsorted(row, np.arange(b - a + 1), side="left")


def band_keys(h: np.ndarray, off: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands) keys; `off` has no empty sets."""
    r = np.random.Generator(np.random.PCG64(1010))
    odd = r.integers(1, 2**63, bands * BAND, dtype=U64) * U64(2) + U64(1)
    out = np.empty((len(off) - 1, bands), dtype=U64)
    for j in range(bands):
        key = np.full(len(off) - 1, j, dtype=U64)
        for i in range(BAND):
            x = h * odd[j * BAND + i]
            key = mix(key ^ np.minimum.reduceat(x ^ (x >> U64(29)), off[:-1]))
        out[:, j] = key
    return out


def describe(batches, words: int, bands: int):
    """id, text hash, n, two hashes of the set, band keys; the sets themselves stay behind."""
    for b in batches:
        ids, th, rest = b.column("id"), b.column("th"), b.column("rest")
        for row0, h, off in shingle_sets(b.column("text"), words):
            n = np.diff(off)
            full = np.flatnonzero(n)
            f1, f2, keys = np.zeros(len(n), dtype=U64), np.zeros(len(n), dtype=U64), np.zeros((len(n), bands), dtype=U64)
            if len(full):
                at = off[:-1][full]
                f1[full], f2[full] = np.add.reduceat(h, at), np.bitwise_xor.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), at)
                keys[full] = band_keys(h, np.append(at, off[-1]), bands)
            ends = (np.concatenate([[0], np.cumsum(n > 0)]) * bands).astype(np.int32)
            yield table_of(id=ids.slice(row0, len(n)), th=th.slice(row0, len(n)), rest=rest.slice(row0, len(n)), n=n, f1=f1, f2=f2, bands=pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel().view(np.int64))))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def open_runs(sets: list[np.ndarray], queries: np.ndarray, members: np.ndarray, percent: int, forest: Forest) -> None:
    """Link every query with every member at the threshold or over it, by the token-group matrix of the members."""
    size = np.array([len(s) for s in sets])
    members = np.array(sorted(members, key=lambda i: tuple(sets[i][:3])))
    tokens = np.concatenate([sets[i] for i in members])
    place = np.repeat(np.arange(len(members)), size[members])
    order = np.argsort(tokens, kind="stable")
    tokens, place = tokens[order], place[order]
    run = place // RUN
    first = np.ones(len(tokens), dtype=bool)  # a token once for each run: the matrix
    order = np.lexsort((run, tokens))
    mt, mr = tokens[order], run[order]
    first[1:] = (mt[1:] != mt[:-1]) | (mr[1:] != mr[:-1])
    mt, mr = mt[first], mr[first]
    runs = int(run.max()) + 1
    # rows of the matrix as postings, and the postings of each run for opening it
    by_run = [(tokens[run == g], place[run == g]) for g in range(runs)]
    for q in queries:
        x, n = sets[q], size[q]
        lo, hi = np.searchsorted(mt, x, side="left"), np.searchsorted(mt, x, side="right")
        held = np.bincount(mr[ranges(lo, hi - lo)], minlength=runs)
        for g in np.flatnonzero(100 * held >= percent * n):
            t, p = by_run[g]
            lo, hi = np.searchsorted(t, x, side="left"), np.searchsorted(t, x, side="right")
            both = np.bincount(p[ranges(lo, hi - lo)] - g * RUN, minlength=min(RUN, len(members) - g * RUN))
            other = members[g * RUN : (g + 1) * RUN]
            for y in other[100 * both >= percent * (n + size[other] - both)]:
                if y != q:
                    forest.join(int(q), int(y))


def link_groups(batches, percent: int):
    """Rows of one group block pair (g, i, j), together, sorted: (node, least node it is linked with here)."""
    rest: pa.Table | None = None

    def settle(t: pa.Table):
        g, i, j = (t.column(x).to_numpy() for x in ("g", "i", "j"))
        new = np.ones(len(g) + 1, dtype=bool)
        new[1:-1] = (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        edge = np.flatnonzero(new)
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        body = t.column("tokens").combine_chunks()
        out_a: list[int] = []
        out_b: list[int] = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo < 2:
                continue
            order = lo + np.argsort(node[lo:hi], kind="stable")
            sets = [np.frombuffer(body[int(r)].as_buffer(), dtype=U64) for r in order]
            forest = Forest(len(sets))
            every = np.arange(len(sets))
            if i[lo] == j[lo]:
                open_runs(sets, every, every, percent, forest)
            else:
                left = side[order] == i[lo]
                if left.any() and not left.all():
                    open_runs(sets, every[left], every[~left], percent, forest)
            for k in range(len(sets)):
                r = forest.root(k)
                if r != k:
                    out_a.append(int(node[order[k]]))
                    out_b.append(int(node[order[r]]))
        if out_a:
            yield table_of(a=np.array(out_a), b=np.array(out_b))

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        last = t.slice(t.num_rows - 1)
        same = np.ones(t.num_rows, dtype=bool)
        for x in ("g", "i", "j"):
            same &= t.column(x).to_numpy() == last.column(x)[0].as_py()
        whole = int(np.argmax(same))
        if whole:
            yield from settle(t.slice(0, whole))
        rest = t.slice(whole)
    if rest is not None and rest.num_rows:
        yield from settle(rest)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents that links join, where two documents link when 100 * |a & b| >=
    `percent` * |a | b| for their sets of distinct `words`-word shingles (words: runs of
    characters other than space and \\x09-\\x0D, A-Z lower-cased; with fewer words, the
    whole sequence is the one shingle).

    Returns a row for every row: the other columns of `docs` (any names) in a struct `row`,
    ``n_shingles`` and ``component_id``, the least id reachable by links, itself included.

    NULL, empty and blank texts have an empty set and link with nothing.  A NULL id takes no
    part: its component is NULL.  Ids name the nodes of the link graph: rows that share one
    may be joined by that.  Equal sets link.  An empty table gives no rows.
    """
    out = _labelled(docs, id_col, text_col, words, percent)
    return out.select(F.col("rest").alias("row"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("top", "id")).alias("component_id"))


def text_key(text_col: str) -> Column:
    """64 bits of the text; NULL has other ones than the empty text."""
    t = F.col(f"`{text_col}`").cast("string")
    return F.xxhash64(F.coalesce(t, F.lit("")), t.isNull())


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """A row for every row: id, th (`text_key`), rest, n, two hashes of the set, and top, the least id of its group;
    top is NULL for empty sets and for sets that no row with an id has."""
    shared_folder(docs)
    bands = bands_for(percent)
    i, t = F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest")
    texts = docs.select(i, t)
    rows = docs.select(i, text_key(text_col).alias("th"), t, rest)
    kind = rows.schema["rest"].dataType.simpleString()
    seen = rows.mapInArrow(lambda x: describe(x, words, bands), f"id long, th long, rest {kind}, n long, f1 long, f2 long, bands array<long>").checkpoint()
    sets = seen.where("n > 0 and id is not null")
    entries = sets.groupBy("f1", "f2", "n").agg(F.min("id").alias("node"), F.any_value("bands").alias("bands"))

    keys = entries.select("node", F.explode("bands").alias("key"))
    first = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").select("key", "lead")
    met = keys.join(first, "key").where("node <> lead").select("lead", "node").distinct()
    groups = components(met).withColumnsRenamed({"component": "g"})
    sizes = groups.join(entries.select("node", "n"), "node").groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("long").alias("blocks"))
    members = groups.join(sizes, "g")

    packed = texts.where("id is not null").mapInArrow(pack_texts, "id long, packed binary, size long")
    wanted = packed.join(members, packed["id"] == members["node"]).select("g", "blocks", "node", "packed", "size")

    def tokens(batches):
        for b, text in unpacked(batches):
            for row0, h, off in shingle_sets(text, words):
                part = b.slice(row0, len(off) - 1)
                ends = (off * 8).astype(np.int32)
                yield table_of(g=part.column("g"), blocks=part.column("blocks"), node=part.column("node"), tokens=pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(ends), pa.py_buffer(h)]))

    side = F.pmod(F.xxhash64("node"), "blocks").alias("side")
    pairs = (
        wanted.mapInArrow(tokens, "g long, blocks long, node long, tokens binary").select("*", side)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select("g", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "tokens")
        .repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    )
    links = components(pairs.mapInArrow(lambda x: link_groups(x, percent), "a long, b long"))

    label = entries.select("f1", "f2", "n", "node").join(links, "node", "left").select("f1", "f2", "n", F.coalesce("component", "node").alias("top"))
    return seen.join(label, ["f1", "f2", "n"], "left")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group; all of its columns, unchanged.

    The row that stays has the least id (NULL comes last), of rows with one id the least
    hash of the text; of rows with that id and text, one stays.  Rows that share an id are
    judged by their own texts.  A NULL id is no node of the link graph: such a row goes if
    its set of shingles is that of a row that stays or of one that another stands for.
    Documents without words stay, all of them.
    """
    found = _labelled(docs, id_col, text_col, words, percent).where("n > 0")
    group = F.when(F.col("top").isNotNull(), F.struct(F.lit(0).alias("own"), F.col("top").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n")))
    group = group.otherwise(F.struct(F.lit(1).alias("own"), F.col("f1").alias("a"), F.col("f2").alias("b"), F.col("n").alias("n"))).alias("group")
    # rows with one id and one text have one set; (i, none, th) names them
    named = [F.coalesce("id", F.lit(0)).alias("i"), F.col("id").isNull().alias("none"), "th"]
    rows = found.select(group, *named).groupBy("group", "i", "none", "th").agg(F.count("*").alias("k")).checkpoint()
    first = rows.groupBy("group").agg(F.min(F.struct("none", "i", "th")).alias("first"))
    rows = rows.join(first, "group").select("i", "none", "th", "k", (F.struct("none", "i", "th") == F.col("first")).alias("stays")).checkpoint()
    own = F.col(f"`{id_col}`").cast("long")
    name = lambda x: (F.coalesce(own, F.lit(0)) == F.col(f"{x}.i")) & (own.isNull() == F.col(f"{x}.none")) & (text_key(text_col) == F.col(f"{x}.th"))
    left = docs.join(rows.where("not stays").alias("g"), name("g"), "left_anti")
    repeated = rows.where("stays and k > 1")
    if repeated.isEmpty():
        return left
    once = left.join(repeated.alias("g"), name("g"), "left_anti")
    again = left.join(repeated.alias("g"), name("g"), "left_semi")
    # a partial aggregate per task, so repeated rows are one row a task before they move
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = again.groupBy(own.alias("__i"), text_key(text_col).alias("__th")).agg(F.first(F.struct(*columns)).alias("__row")).select("__row.*")
    return once.unionByName(again)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`: 4-word shingles, 85 percent."""
    out = jaccard_groups(docs.select("doc_id", "text"), words=4, percent=85)
    return out.select("row.doc_id", "n_shingles", "component_id")
