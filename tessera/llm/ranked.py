"""Operator 12: ranked lexical search, by MaxScore with pair bounds.

1. One pass over the texts cuts them into *index blocks* of at most `BLOCK_DOCS` documents:
   for every query term its postings (document, occurrences).  The blocks, without any other
   term, are checkpointed; the numbers of documents, terms and documents a term (N, L, df)
   are aggregates over them.
2. In each block the terms' impacts (their parts of the score) follow from N, L and df.  The
   terms of a query are paired, rarest with next rarest, and for each pair the block holds
   the intersection of the two lists with its joint maximum impact.  A pair can't give a
   document more than the larger of its two single maxima and its joint maximum, which for
   rare terms is about half of the sum of the maxima, the bound of plain MaxScore.
3. A query goes over the blocks of a task with the score of its tenth, fiftieth, ... best
   document so far as threshold.  Its pairs are ordered by bound; the longest run of the
   least ones whose bounds add up to less than the threshold is non-essential: a document
   with terms of these only can't get in.  Candidates come from the other pairs' lists; they
   are looked up in the non-essential ones while their sum and the bounds left reach the
   threshold.  Where all pairs are non-essential, the block is passed over.
4. Every task gives its best `k` a query, and a window with a partial limit the best of all.

Small splits are read together and small results stay in few tasks, whatever the numbers of
splits and shuffle partitions: each task writes a file of blocks, or of results, and gives `k`
documents a query.

All sums are 64-bit integers, so the result is exact and the same for every partitioning.
Queries come to the driver in blocks of `QUERY_BYTES`; what is broadcast has that bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.components import shared_folder
from tessera.llm.hashing import FIRST, U64, word_codes
from tessera.llm.words import FOLDED, WORD, word_pieces

TOP = 50
#: Documents of an index block at most (numbers in 16 bits), and bytes of query terms in one broadcast.
BLOCK_DOCS, QUERY_BYTES = 1024, 4 << 20
#: Documents that a task of small splits takes, and rows that a task of the last selection takes, about.
TASK_DOCS, TASK_ROWS = 4 * 1024, 1 << 18
NO_ID = np.iinfo(np.int64).max


@dataclass
class Queries:
    """Queries by number, their terms as numbers in the vocabulary, whose codes are ascending."""

    ids: list
    terms: list[np.ndarray]
    codes: np.ndarray
    #: By the low 16 bits of a code: whether any term has them.
    seen: np.ndarray = field(init=False)

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.codes & U64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the codes are query terms, and their numbers."""
        at = np.flatnonzero(self.seen[(codes & U64(0xFFFF)).astype(np.int64)])
        if not len(self.codes) or not len(at):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        ok = self.codes[term] == codes[at]
        return at[ok], term[ok]


def codes_of(words: list[str]) -> np.ndarray:
    size = np.array([len(w.encode()) for w in words], dtype=np.int64)
    ends = np.cumsum(size)
    return word_codes(np.frombuffer("".join(words).encode(), dtype=np.uint8), ends - size, ends, FOLDED, FIRST) if words else np.zeros(0, dtype=U64)


def query_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Queries]:
    """The distinct terms of the items, in blocks.  Rows with one id are one item; items without terms are left out."""
    lower = F.translate(F.col(f"`{text_col}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1))
    rows = items.select(F.col(f"`{id_col}`").alias("item"), words.alias("w")).groupBy("item").agg(F.array_distinct(F.flatten(F.collect_set("w"))).alias("w")).where(F.size("w") > 0)
    held: list = []
    size = 0

    def block() -> Queries:
        vocabulary = sorted({t for _, w in held for t in w})
        codes = codes_of(vocabulary)
        order = np.argsort(codes)
        number = dict(zip((vocabulary[i] for i in order), range(len(order)), strict=True))
        return Queries([i for i, _ in held], [np.array(sorted(number[t] for t in w)) for _, w in held], codes[order])

    for row in rows.toLocalIterator():
        held.append((row["item"], row["w"]))
        size += sum(len(t.encode()) for t in row["w"])
        if size >= block_bytes:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def postings(text: pa.Array, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of every row, and (row, query term, occurrences) ordered by row and term."""
    n = np.zeros(len(text), dtype=np.int64)
    width = max(len(queries.codes), 1)
    keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for piece in word_pieces(text):
        n[piece.row0 : piece.row0 + len(piece.first) - 1] += np.diff(piece.first)
        at, term = queries.numbers(piece.codes())
        k, c = np.unique(piece.rows()[at] * width + term, return_counts=True)
        keys.append(k)
        counts.append(c)
    # only the row that two pieces share has a key twice
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.add.reduceat(count, head) if len(head) else count
    return n, key[head] // width, key[head] % width, count


@dataclass
class Block:
    """Postings of an index block, by term; `at[t]` is a term's place in the lists, -1 without any."""

    ids: np.ndarray  # NO_ID for NULL
    n: np.ndarray
    term: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    tf: np.ndarray

    def weigh(self, weights: np.ndarray, docs: int, words: int) -> None:
        m = 50 + (50 * self.n * docs) // words
        w = np.repeat(weights[self.term], np.diff(self.ends))
        self.impact = w * ((1_000_000_000 * self.tf) // (1000 * self.tf + 20 * m[self.doc]))
        self.at = np.full(len(weights), -1, dtype=np.int64)
        self.at[self.term] = np.arange(len(self.term))
        self.most = np.maximum.reduceat(self.impact, self.ends[:-1]) if len(self.term) else self.impact

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[i], self.ends[i + 1]
        return self.doc[a:b], self.impact[a:b]

    def joint(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that hold both terms, and what both give them."""
        (a, x), (b, y) = self.postings(i), self.postings(j)
        both, p, q = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return both, x[p] + y[q]

    def pair_bounds(self, pairs: np.ndarray) -> np.ndarray:
        """What each pair of terms (places, -1 for none) can give a document of this block at most."""
        single = np.append(self.most, 0)[pairs]  # -1 reads the 0 at the end
        bound = single.max(axis=1)
        for k in np.flatnonzero((pairs >= 0).all(axis=1)):
            both, gain = self.joint(*pairs[k])
            if len(both):
                bound[k] = max(bound[k], gain.max())
        return bound


def pairs_of(queries: Queries, weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct pairs of terms of all queries (the last of an odd number has -1), and each query's pairs."""
    number: dict[tuple[int, int], int] = {}
    of = []
    for terms in queries.terms:
        t = terms[weights[terms] > 0]
        t = t[np.lexsort((t, -weights[t]))].tolist()
        of.append(np.array([number.setdefault((a, b), len(number)) for a, b in zip(t[0::2], [*t[1::2], *([-1] * (len(t) % 2))], strict=True)], dtype=np.int64))
    return np.array(list(number) or np.zeros((0, 2)), dtype=np.int64), of


def best_of(block: Block, pairs: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block with a sum of at least `least`, and the sums; `pairs` are places, `bounds` theirs."""
    order = np.argsort(bounds, kind="stable")
    order = order[np.searchsorted(bounds[order], 0, side="right") :]  # pairs without postings
    reach = np.cumsum(bounds[order])
    rest = int(np.searchsorted(reach, least))  # non-essential: order[:rest]
    if rest == len(order):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    total = np.zeros(len(block.ids), dtype=np.int64)
    for k in order[rest:]:
        for i in pairs[k]:
            if i >= 0:
                doc, impact = block.postings(i)
                total[doc] += impact
    found = np.flatnonzero(total)
    for left in range(rest - 1, -1, -1):
        found = found[total[found] + reach[left] >= least]
        if not len(found):
            break
        for i in pairs[order[left]]:
            if i >= 0:
                doc, impact = block.postings(i)
                at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                total[found] += np.where(doc[at] == found, impact[at], 0)
    found = found[total[found] >= least]
    return found, total[found]


def search(blocks: Iterator[Block], queries: Queries, weights: np.ndarray, docs: int, words: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best `k` documents of the blocks for each query."""
    pairs, of = pairs_of(queries, weights)
    none = np.zeros(0, dtype=np.int64)
    best = [(none, none)] * len(of)
    least = np.ones(len(of), dtype=np.int64)
    for block in blocks:
        block.weigh(weights, docs, words)
        places = np.append(block.at, -1)[pairs]
        bounds = block.pair_bounds(places)
        for q, own in enumerate(of):
            doc, score = best_of(block, places[own], bounds[own], least[q])
            if len(doc):
                ids, score = np.concatenate([best[q][0], block.ids[doc]]), np.concatenate([best[q][1], score])
                order = np.lexsort((ids, -score))[:k]
                best[q] = ids[order], score[order]
                if len(order) == k:
                    least[q] = score[order[-1]]
    return np.repeat(np.arange(len(best)), [len(i) for i, _ in best]), np.concatenate([i for i, _ in best] or [none]), np.concatenate([s for _, s in best] or [none])


def index_blocks(docs: DataFrame, id_col: str, text_col: str, queries: Queries) -> DataFrame:
    """The index blocks of the documents with terms: ids, n, and for each term its documents (`df`) in `post`."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def cut(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, (n, row, term, tf) = b.column("id"), postings(b.column("text"), shared.value)
            for a in range(0, b.num_rows, BLOCK_DOCS):
                z = min(a + BLOCK_DOCS, b.num_rows)
                lo, hi = np.searchsorted(row, [a, z])
                order = np.lexsort((row[lo:hi], term[lo:hi]))
                t, df = np.unique(term[lo:hi], return_counts=True)
                post = press.compress((row[lo:hi][order] - a).astype("<u2").tobytes() + tf[lo:hi][order].astype("<i8").tobytes())
                lists = [ids.slice(a, z - a), pa.array(n[a:z]), pa.array(t), pa.array(df)]
                yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), pa.array([post], pa.binary())], names=["ids", "n", "term", "df", "post"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared_folder(docs)
    return rows.mapInArrow(cut, "ids array<long>, n array<long>, term array<long>, df array<long>, post binary").checkpoint()


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    open_ = zstandard.ZstdDecompressor()
    for b in batches:
        for i in range(b.num_rows):
            ids, n, term, df = (b.column(c)[i].values for c in ("ids", "n", "term", "df"))
            raw = open_.decompress(b.column("post")[i].as_py())
            total = len(raw) // 10
            ends = np.concatenate([[0], np.cumsum(df.to_numpy())])
            yield Block(ids.fill_null(NO_ID).to_numpy(), n.to_numpy(), term.to_numpy(), ends, np.frombuffer(raw, "<u2", total).astype(np.int64), np.frombuffer(raw, "<i8", total, 2 * total))


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """The `k` documents with the highest scores for each item: item_id, rank (from 1), doc_id, score.

    A score sums ``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` over the item's distinct terms,
    with ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and ``m = 50 + (50 * n * N) div L``.
    Documents with equal scores are ordered by id, NULL last.  Only scores above 0 count.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z in lower case, told
    apart by 64-bit hashes.  NULL and empty texts have no terms and aren't counted.  Every
    row is a document, also where ids repeat.  Item rows with one id (NULL is one too) are one
    item with the terms of all their texts; items without terms get no rows.  An empty table
    on either side gives no rows.
    """
    docs = docs.coalesce(max(math.ceil(docs.count() / TASK_DOCS), docs.sparkSession.sparkContext.defaultParallelism))
    parts, rows = [], 0
    for queries in query_blocks(items, item_id, item_text, block_bytes):
        parts.append(_search_block(docs, queries, id_col, text_col, items.schema[item_id].dataType, k))
        rows += parts[-1].rdd.getNumPartitions() * len(queries.ids) * k  # at most
    kind = items.schema[item_id].dataType.simpleString()
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score").coalesce(max(math.ceil(rows / TASK_ROWS), 1))


def _search_block(docs: DataFrame, queries: Queries, id_col: str, text_col: str, kind, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    blocks = index_blocks(docs, id_col, text_col, queries)
    sizes = blocks.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_words = sizes[0], sizes[1] or 0
    # one row a query term at most
    df = blocks.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect()
    weights = np.zeros(len(queries.codes), dtype=np.int64)
    for r in df:
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    shared = context.broadcast((queries, weights))
    item_type = to_arrow_type(kind)

    def best(batches):
        queries, weights = shared.value
        q, ids, score = search(read_blocks(batches), queries, weights, n_docs, n_words, k)
        if len(q):
            item = pa.array(queries.ids, item_type).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([item, pa.array(ids, mask=ids == NO_ID), pa.array(score)], names=["item_id", "doc_id", "score"])

    return blocks.select("ids", "n", "term", "df", "post").mapInArrow(best, f"item_id {kind.simpleString()}, doc_id long, score long")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns for `documents` and `benchmark`."""
    return ranked_search(docs.select("doc_id", "text"), items.select("item_id", "text"))
