"""Operator 11: benchmark passages in documents, by Wu-Manber multi-pattern search over words.

The patterns are the windows of `window` consecutive words of every benchmark item (an item
of fewer words is one window).  Windows of one length make up a `Patterns` table:

* a shift table over blocks of two words: how far the window may move on when its last block
  is this one.  A block that no pattern holds moves it by a whole window less one word, so
  most positions of a clean document are never looked at;
* where the shift is 0, the hash of the last block chooses a bucket of test strings, and that
  of the first block narrows it;
* direct comparison, length by length and byte by byte, confirms every occurrence.

Texts are read once, in parallel and without a shuffle.  Many places of a text are scanned
at the same time: it is cut into lanes, and each step moves the windows of all lanes.

The benchmark comes to the driver piece by piece.  Its tables are broadcast in blocks of at
most `BLOCK_BYTES` (and one piece of `PIECE_WORDS` words); a benchmark beyond that takes one
pass over the documents a block, and the passes' findings are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import FIRST, SECOND, U64, byte_table, mix, word_codes
from tessera.llm.words import FOLD, FOLDED, WORD, gather, word_pieces

WINDOW = 10
#: Bytes of benchmark words in one broadcast, and words of an item that come to the driver in one row.
BLOCK_BYTES, PIECE_WORDS = 4 << 20, 4096
#: Bits of the shift table's index; window starts of a lane.
SHIFT_BITS, LANE = 20, 512
SECOND_CODES = byte_table(20313, fold_case=True)
SPANS = "array<struct<start:long,end:long>>"


def blocks_of(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` (1 or 2) words from `at` on."""
    return mix(codes[at] * U64(0xA24BAED4963EE407) + codes[at + 1]) if width == 2 else codes[at]


@dataclass
class Patterns:
    """Distinct windows of `m` words: places in the words of the items, shift table, buckets."""

    m: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    at: np.ndarray  # first word of each pattern, in the order of `keys`
    keys: np.ndarray  # bucket (last block, then first block) of each pattern, ascending
    shift: np.ndarray
    item_off: np.ndarray  # items of pattern p: items[item_off[p]:item_off[p + 1]]
    items: np.ndarray

    @property
    def width(self) -> int:
        return min(2, self.m)

    def bucket(self, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        last, first = blocks_of(codes, start + self.m - self.width, self.width), blocks_of(codes, start, self.width)
        return mix(last * U64(0x9E3779B97F4A7C15) + first)

    @classmethod
    def of(cls, m: int, buf, starts, ends, at: np.ndarray, owner: np.ndarray) -> Patterns:
        """Patterns for the windows that begin with the words `at` and belong to the items `owner`."""
        codes = word_codes(buf, starts, ends, FOLDED, FIRST)
        out = cls(m, buf, starts, ends, codes, at, codes[:0], np.zeros(0), at, owner)
        # equal windows are one pattern, told apart by 128 bits here and by their bytes in the search
        h1 = FIRST.slices(FIRST.sums(codes), at, at + m)
        h2 = SECOND.slices(SECOND.sums(word_codes(buf, starts, ends, SECOND_CODES, SECOND)), at, at + m)
        keys = out.bucket(codes, at)
        order = np.lexsort((owner, h2, h1, keys))
        h1, h2, keys, at, owner = h1[order], h2[order], keys[order], at[order], owner[order]
        head = np.ones(len(at), dtype=bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (keys[1:] != keys[:-1])
        out.at, out.keys, out.items = at[head], keys[head], owner
        out.item_off = np.append(np.flatnonzero(head), len(owner))
        b = out.width
        out.shift = np.full(1 << SHIFT_BITS, m - b + 1, dtype=np.int32)
        for j in range(m - b + 1):  # the block from word j on ends m - b - j words before the window's end
            slot = (blocks_of(codes, out.at + j, b) & U64((1 << SHIFT_BITS) - 1)).astype(np.int64)
            np.minimum.at(out.shift, slot, m - b - j)
        return out

    def search(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, pattern) of every occurrence that lies within one row."""
        at = self.candidates(codes)
        at = at[row[at] == row[at + self.m - 1]]
        key = self.bucket(codes, at)
        lo, hi = np.searchsorted(self.keys, key, side="left"), np.searchsorted(self.keys, key, side="right")
        n = hi - lo
        start = np.repeat(at, n)
        pattern = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(at) else lo
        ok = np.ones(len(start), dtype=bool)
        size = np.zeros(len(start), dtype=np.int64)
        for j in range(self.m):
            d, p = start + j, self.at[pattern] + j
            length = ends[d] - starts[d]
            ok &= (codes[d] == self.codes[p]) & (length == self.ends[p] - self.starts[p])
            size += length
        start, pattern, size = start[ok], pattern[ok], size[ok]
        if not len(start):
            return start, pattern
        equal = [np.zeros(0, dtype=bool)]
        step = max(1, int((1 << 22) // max(int(size.max()), 1)))
        for a in range(0, len(start), step):  # some MB of bytes at a time
            d, p = ((x[a : a + step, None] + np.arange(self.m)).ravel() for x in (start, self.at[pattern]))
            differ = FOLD[gather(buf, starts[d], ends[d])] != gather(self.buf, self.starts[p], self.ends[p])
            equal.append(np.add.reduceat(differ, np.concatenate([[0], np.cumsum(size[a : a + step])[:-1]])) == 0)
        same = np.concatenate(equal)
        return start[same], pattern[same]

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Window starts at which the shift is 0, ascending."""
        n, b = len(codes) - self.m + 1, self.width
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        lane = np.arange(0, n, LANE)
        stop = np.minimum(lane + LANE, n)
        found = []
        while len(lane):
            by = self.shift[(blocks_of(codes, lane + self.m - b, b) & U64((1 << SHIFT_BITS) - 1)).astype(np.int64)]
            found.append(lane[by == 0])
            lane = lane + np.maximum(by, 1)
            on = lane < stop
            lane, stop = lane[on], stop[on]
        return np.sort(np.concatenate(found))


def item_pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, w): the words of the items in arrays of at most `PIECE_WORDS` and `window - 1` words, which hold every
    window once.  Items without words are left out; a NULL id is the empty string."""
    lower = F.translate(F.col(f"`{text_col}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1)
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), words.alias("all")).where(F.size("all") > 0)
    cuts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(PIECE_WORDS))
    return rows.select("item", "all", F.explode(cuts).alias("p")).select("item", F.slice("all", F.col("p") + 1, PIECE_WORDS + window - 1).alias("w"))


def pattern_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[tuple[list[str], list[Patterns]]]:
    """Items (sorted) and pattern tables, block by block."""
    held: list[tuple[str, list[str]]] = []
    size = 0
    for row in item_pieces(items, id_col, text_col, window).toLocalIterator():
        held.append((row["item"], row["w"]))
        size += sum(len(x.encode()) + 1 for x in row["w"])
        if size >= block_bytes:
            yield tables(held, window)
            held, size = [], 0
    if held:
        yield tables(held, window)


def tables(held: list[tuple[str, list[str]]], window: int) -> tuple[list[str], list[Patterns]]:
    names = sorted({item for item, _ in held})
    number = {item: i for i, item in enumerate(names)}
    flat = [x.encode() for _, w in held for x in w]
    size = np.array([len(x) for x in flat], dtype=np.int64)
    ends = np.cumsum(size)
    buf = np.frombuffer(b"".join(flat), dtype=np.uint8)
    of: dict[int, tuple[list, list]] = {}
    base = 0
    for item, w in held:
        m = min(window, len(w))
        at, owner = of.setdefault(m, ([], []))
        at.append(base + np.arange(len(w) - m + 1))
        owner.append(np.full(len(w) - m + 1, number[item], dtype=np.int64))
        base += len(w)
    return names, [Patterns.of(m, buf, ends - size, ends, np.concatenate(at), np.concatenate(owner)) for m, (at, owner) in sorted(of.items())]


def union(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans, row by row, in order."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    span = int(end.max()) + 1  # rows apart from each other
    reach = np.maximum.accumulate(end + row * span)
    head = np.ones(len(row), dtype=bool)
    head[1:] = (row[1:] != row[:-1]) | (start[1:] + row[1:] * span > reach[:-1])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(row) - 1)
    return row[head], start[head], reach[last] - row[head] * span


def nested(rows: int, row: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1), side="left").astype(np.int32)), values)


def span_lists(rows: int, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return nested(rows, row, pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))


def scan(text: pa.Array, names: pa.Array, groups: list[Patterns]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words, hit spans (maximal, in words) and items (sorted) of every row."""
    rows = len(text)
    n_words = np.zeros(rows, dtype=np.int64)
    hits: list[tuple[np.ndarray, ...]] = []
    own: list[np.ndarray] = []
    for piece in word_pieces(text, lap=max((g.m for g in groups), default=1) - 1):
        n_words[piece.row0 : piece.row0 + len(piece.first) - 1] += np.diff(piece.first) - piece.lap
        codes, row = piece.codes(), piece.rows()
        for g in groups:
            start, pattern = g.search(piece.buf, piece.starts, piece.ends, codes, row)
            if len(start):
                local = start - piece.first[row[start] - piece.row0] + piece.base
                hits.append((row[start], local, local + g.m))
                n = np.diff(g.item_off)[pattern]
                item = g.items[np.repeat(g.item_off[pattern] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
                own.append(np.unique(np.repeat(row[start], n) * len(names) + item))
    row, start, end = union(*(np.concatenate(x) for x in zip(*hits, strict=True))) if hits else (np.zeros(0, dtype=np.int64),) * 3
    owned = np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.int64)
    return n_words, span_lists(rows, row, start, end), nested(rows, owned // max(len(names), 1), names.take(pa.array(owned % max(len(names), 1))))


def merge_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`more` (spans of other passes) joined with `spans`, as maximal runs again."""
    for b in batches:
        lists = [b.column(c) for c in ("spans", "more")]
        row = np.concatenate([np.repeat(np.arange(b.num_rows), np.asarray(x.value_lengths().fill_null(0))) for x in lists])
        start, end = (np.concatenate([x.flatten().field(k).to_numpy(zero_copy_only=False) for x in lists]) for k in (0, 1))
        columns = {n: b.column(n) for n in b.schema.names if n != "more"}
        columns["spans"] = span_lists(b.num_rows, *union(row, start.astype(np.int64), end.astype(np.int64)))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where windows of benchmark items stand in documents.

    Returns the other columns of `docs` (any names) in a struct `row`, ``n_words``, ``spans``
    (array of (start, end) in words: maximal runs of words inside occurrences, in order),
    ``n_hit`` (words in them) and ``items`` (array of the items with an occurrence, as
    strings, sorted).

    NULL and empty texts have no words, and items without words are found nowhere.  Items
    that share an id count as one, with the windows of all their texts; a NULL item id is
    the empty string.  Every row of `docs` is scanned on its own, whatever its id.  An empty
    table of documents gives no rows, an empty benchmark no hits.
    """
    kind = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")).schema["row"].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    key = [F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`").isNull()).alias("k1"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k2")]
    rows = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row"), text.alias("text"))
    context = docs.sparkSession.sparkContext

    def found(block: tuple[list[str], list[Patterns]], hits_only: bool) -> DataFrame:
        tables = context.broadcast(block)

        def search(batches):
            names, groups = tables.value
            names = pa.array(names, pa.string())
            for b in batches:
                n_words, spans, own = scan(b.column("text"), names, groups)
                columns = {n: b.column(n) for n in b.schema.names if n != "text"} | {"n_words": pa.array(n_words), "spans": spans, "items": own}
                out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                yield out.filter(pa.array(np.asarray(spans.value_lengths()) > 0)) if hits_only else out

        if hits_only:
            return rows.select("k1", "k2", "text").mapInArrow(search, f"k1 long, k2 long, n_words long, spans {SPANS}, items array<string>")
        return rows.mapInArrow(search, f"k1 long, k2 long, row {kind}, n_words long, spans {SPANS}, items array<string>")

    out, others = None, []
    for block in pattern_blocks(items, item_id, item_text, window, block_bytes):
        if out is None:
            out = found(block, hits_only=False)
        else:
            others.append(found(block, hits_only=True))
    out = found(([], []), hits_only=False) if out is None else out
    if others:
        every = others[0]
        for one in others[1:]:
            every = every.unionByName(one)
        # rows with one id and one text have the same findings, and one row of the aggregate
        every = every.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("more"), F.flatten(F.collect_set("items")).alias("their"))
        out = out.join(every, ["k1", "k2"], "left").withColumn("items", F.array_sort(F.array_union("items", F.coalesce("their", F.array().cast("array<string>"))))).drop("their")
        out = out.select("row", "n_words", "items", "spans", "more").mapInArrow(merge_found, f"row {kind}, n_words long, items array<string>, spans {SPANS}")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("row", "n_words", "spans", total.alias("n_hit"), "items")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns for `documents` and `benchmark`."""
    out = decontaminate(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return out.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
