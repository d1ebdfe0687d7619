"""Windows of a fixed length that also start earlier in the corpus, found exactly.

Shared by `suffix_dedup` (100-byte windows) and `substring_dedup` (20-word windows).
A document is a sequence of codes (bytes or word hashes); corpus order is (document,
position).  A window is *repeated* when an equal window starts earlier in that order.

1. Every window picks its *anchor*: the k-gram in it with the least rolling hash (the
   rightmost of equals).  The choice depends on the window's content alone, so equal
   windows pick the same anchor at the same place.  Neighbouring windows that pick one
   anchor form a *phrase*; phrases cut a document's windows into disjoint runs and
   overlap by all but one code of a window, so each window lies in exactly one phrase.
2. An anchor content that occurs once in the corpus has no repeated window: its phrases
   leave the job here, after one aggregate over (anchor hash) with map-side combining.
3. The rest form the *dictionary*: equal phrases (anchor hash and content hash, 128
   bits) are one entry with its first occurrence.  Later occurrences are repeated
   throughout.  An entry that is alone with its anchor content is new throughout.
4. Entries that share an anchor content with different entries agree in some of their
   windows only.  Their windows, and no others, are put in classes of equal ones; the first
   of each class is new.  The entries of one anchor come together whole, and the operator
   says which of their windows are equal: `suffix_dedup` by the suffix order of the entries,
   `substring_dedup` by extending the anchor both ways.  Where an anchor is too frequent for
   that, windows are spread over all tasks one by one and told apart by 128-bit hashes.

Everything is an aggregate with map-side combining, or a join on hashes that adaptive
execution can split, so a passage in a third of all documents costs one row per task.
No pair of documents is ever formed.

A document is named by its id and 64 bits (`tie`): a hash of the text, its last bit telling
a NULL id from id 0.  Rows that share an id are ordered by it; rows with one id and one text
count as one document and each gets its result.  A NULL id counts as an id next to 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import FIRST, SECOND, U64, pack_texts, sliding_min, unpacked

#: loc = start << 8 | count: a run of `count` windows from `start` on.
COUNT_BITS = 8
LOW32 = U64(0xFFFFFFFF)

#: For the rows of a column, block by block: the block's first row, its items (bytes, or word codes), the offsets of
#: its rows, and the position of its first item in the row (not 0 for a later piece of a long row; pieces overlap by a
#: window less one item).
Coder = Callable[[pa.Array, int], Iterator[tuple[int, np.ndarray, np.ndarray, int]]]
#: Items to codes.
Codes = Callable[[np.ndarray], np.ndarray]
#: Of phrases (items, offsets, windows of each, anchors): a class for each window in turn, the same for equal ones.
Classes = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Phrases whose anchor content occurs so often at most are compared in one place; those of more frequent anchors
#: window by window, spread over all tasks.
TOGETHER = 1 << 15
NOT_NULL = "{} is not null and {} is not null"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(dk, tie, rest, packed, size): a key that is never NULL, all other columns in one
    struct and the text, partitioned by (dk, tie)."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    tie = F.xxhash64(F.coalesce(t, F.lit(""))).bitwiseAND(F.lit(-2)).bitwiseOR(i.isNull().cast("long"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.coalesce(i, F.lit(0)).alias("dk"), tie.cast("long").alias("tie"), F.struct(*rest).alias("rest"), t.cast("string").alias("text"))
    kind = rows.schema["rest"].dataType.simpleString()
    return rows.mapInArrow(pack_texts, f"dk long, tie long, rest {kind}, packed binary, size long").where(NOT_NULL.format("dk", "tie")).repartition("dk", "tie")


def phrases(codes: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(row, start, count, anchor hash, content hash) of the phrases of a block of rows."""
    m = length - k + 1
    sums = FIRST.sums(codes)
    grams = FIRST.grams(sums, k) * U64(0xD6E8FEB86659FD93)
    n = len(grams)
    if n < m:
        return None
    # the rightmost of the least: the high half of the hash, then the reversed position
    least = sliding_min((grams & ~LOW32) | (LOW32 - np.arange(n, dtype=U64)), m)
    owner = (LOW32 - (least & LOW32)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(owner)]
    ok = np.arange(len(owner)) + length <= offsets[row + 1]
    p = np.flatnonzero(ok)
    if not len(p):
        return None
    new = np.ones(len(p), dtype=bool)
    new[1:] = (owner[p[1:]] != owner[p[:-1]]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(new)
    start, count = p[head], np.diff(np.append(head, len(p)))
    at = owner[start]
    sums2 = SECOND.sums(codes)
    content = SECOND.slices(sums2, start, start + count + (length - 1))
    content = content + ((at - start) * 256 + count).astype(U64) * U64(0xA24BAED4963EE407)
    return row[start], start - offsets[row[start]], count, grams[at], content


def window_hashes(codes: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    s1, s2 = FIRST.sums(codes), SECOND.sums(codes)
    return FIRST.slices(s1, start, start + length), SECOND.slices(s2, start, start + length)


def _runs(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return loc >> COUNT_BITS, loc & ((1 << COUNT_BITS) - 1)


def mark(n_windows: int, seen: pa.Array | None, new: pa.Array | None) -> np.ndarray:
    """Repeated windows of a document: in a phrase of `seen`, not in a run of `new`."""
    out = np.zeros(n_windows, dtype=bool)
    for value, locs in ((True, seen), (False, new)):
        if locs is not None and len(locs):
            at = ranges(*_runs(np.unique(locs.to_numpy())))
            if len(at) and at.max() >= n_windows:
                raise ValueError("a place outside of its document: two documents share a key")
            out[at] = value
    return out


def covered(repeated: np.ndarray, length: int, n: int) -> np.ndarray:
    """Codes that lie in a repeated window."""
    d = np.zeros(n + 1, dtype=np.int64)
    p = np.flatnonzero(repeated)
    d[p] += 1
    np.subtract.at(d, p + length, 1) if len(p) else None
    return np.cumsum(d[:n]) > 0


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))


def loose(kind: pa.DataType) -> pa.DataType:
    """The type with every nested field nullable, as Spark expects it back."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, loose(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, loose(kind.value_type)))
    return kind


def table_of(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in columns.values()], names=list(columns))


def first_of_class(classes: np.ndarray, dk: np.ndarray, tie: np.ndarray, loc: np.ndarray) -> pa.RecordBatch:
    """Of phrases (their windows' classes, and places), the windows that no earlier one of these phrases holds, as runs."""
    count = loc & ((1 << COUNT_BITS) - 1)
    row = np.repeat(np.arange(len(loc)), count)
    place = ranges(loc >> COUNT_BITS, count)
    order = np.lexsort((place, tie[row], dk[row], classes))
    of = classes[order]
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = of[1:] != of[:-1]
    new = np.sort(order[lead])
    head = np.ones(len(new), dtype=bool)
    head[1:] = (new[1:] != new[:-1] + 1) | (row[new[1:]] != row[new[:-1]])
    at = np.flatnonzero(head)
    return table_of(dk=dk[row[new[at]]], tie=tie[row[new[at]]], loc=(place[new[at]] << COUNT_BITS) | np.diff(np.append(at, len(new))))


def repeated_windows(keys: DataFrame, coder: Coder, codes: Codes, classes: Classes, item: type, length: int, k: int, together: int = TOGETHER) -> DataFrame:
    """One row per document of `keyed` rows: the columns of `keys`, `seen` and `new` (see
    `mark`).  `item` is the numpy type of the coder's items; `classes` says which windows of
    phrases that share an anchor are equal."""

    def found_in(batches):
        """A batch's phrases: anchor, content, dk, tie and loc."""
        for b, text in unpacked(batches):
            dk, tie = b.column("dk").to_numpy(), b.column("tie").to_numpy()
            held: list[tuple[np.ndarray, ...]] = []
            for row0, items, off, base in coder(text, length):
                got = phrases(codes(items), off, length, k)
                if got is not None:
                    row, start, count, anchor, content = got
                    held.append((anchor, content, dk[row + row0], tie[row + row0], ((start + base) << COUNT_BITS) | count))
            if held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def cut(batches):
        for a, c, d, tie, loc in found_in(batches):
            yield table_of(a=a, c=c, dk=d, tie=tie, loc=loc)

    def cut_anchors(batches):
        for a, *_ in found_in(batches):
            yield table_of(a=a)

    # Three readers of the phrases and three of the texts share one exchange each; for that, the columns they take and
    # the filters below the exchange must be the same (joins would add IS NOT NULL to some).
    again = keys.mapInArrow(cut_anchors, "a long").groupBy(F.bitwise_not("a").alias("b")).agg(F.count("*").alias("n")).where("n > 1")
    # joined on ~a, so that the grouping by (a, c) below has a shuffle of its own: a frequent anchor can then be split
    # by the join, and its equal phrases are added up before they move
    seen = keys.mapInArrow(cut, "a long, c long, dk long, tie long, loc long").where(F.expr(NOT_NULL.format("a", "c")) & F.expr(NOT_NULL.format("dk", "tie"))).join(again, F.bitwise_not("a") == F.col("b"))
    entries = seen.groupBy("a", "c").agg(F.min(F.struct("dk", "tie", "loc")).alias("f"), F.max("n").alias("n")).select("a", "f.dk", "f.tie", "f.loc", "n")
    # 0: alone with its anchor content; 1, 2: not, to be compared in one place or window by window
    alone = entries.groupBy("a").agg(F.count("dk").alias("entries"), F.max("n").alias("most"))
    split = F.when(F.col("entries") == 1, 0).when(F.greatest("n", "most") <= together, 1).otherwise(2).alias("split")
    entries = entries.join(alone, "a").select("a", "dk", "tie", "loc", split)
    unclear = entries.where("split > 0").groupBy("dk", "tie").agg(F.collect_list(F.struct("a", "loc", "split")).alias("parts"))
    # all columns of `keys` stay in, so that both joins read one exchange of the texts
    texts = keys.join(unclear, ["dk", "tie"])

    def parts_of(b, text, pick):
        """Items of a block, and of its unclear phrases: dk, tie, anchor, loc, start and count within the items."""
        dk, tie, parts = b.column("dk").to_numpy(), b.column("tie").to_numpy(), b.column("parts")
        ends = parts.offsets.to_numpy()  # into the values of the whole batch, also for a slice
        a, loc, split = (parts.values.field(x).to_numpy() for x in range(3))
        for row0, items, off, base in coder(text, length):
            n = len(off) - 1
            row = np.repeat(np.arange(n), np.diff(ends[row0 : row0 + n + 1]))
            at = slice(ends[row0], ends[row0 + n])
            start, count = _runs(loc[at])
            # the windows that lie in this piece of the row
            lo, hi = np.maximum(start, base), np.minimum(start + count, base + off[row + 1] - off[row] - length + 1)
            ok = (hi > lo) & (split[at] == pick)
            row, lo, hi = row[ok], lo[ok], hi[ok]
            if len(row):
                yield items, dk[row + row0], tie[row + row0], a[at][ok], (lo << COUNT_BITS) | (hi - lo), lo - base + off[row], hi - lo

    def bodies(batches):
        for b, text in unpacked(batches):
            for items, dk, tie, a, loc, start, count in parts_of(b, text, 1):
                size = count + length - 1
                flat = np.ascontiguousarray(items[ranges(start, size)])
                ends = (np.concatenate([[0], np.cumsum(size)]) * flat.itemsize).astype(np.int32)
                yield table_of(a=a, dk=dk, tie=tie, loc=loc, body=pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat)]))

    def settle(batches):
        rest: pa.Table | None = None

        def done(t: pa.Table):
            for b in t.combine_chunks().to_batches():
                body = b.column("body")
                ends = np.frombuffer(body.buffers()[1], dtype=np.int32)[body.offset : body.offset + len(body) + 1]
                raw = np.frombuffer(body.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
                anchors, dk, tie, loc = (b.column(x).to_numpy() for x in ("a", "dk", "tie", "loc"))
                own = classes(raw.view(item), (ends - ends[0]).astype(np.int64) // np.dtype(item).itemsize, loc & ((1 << COUNT_BITS) - 1), anchors.view(U64))
                yield first_of_class(own, dk, tie, loc)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            a = t.column("a").to_numpy()
            whole = int(np.searchsorted(a, a[-1], side="left")) if len(a) else 0  # the last anchor may go on
            if whole:
                yield from done(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield from done(rest)

    def windows(batches):
        for b, text in unpacked(batches):
            for items, dk, tie, _, loc, start, count in parts_of(b, text, 2):
                h1, h2 = window_hashes(codes(items), ranges(start, count), length)
                yield table_of(h1=h1, h2=h2, dk=np.repeat(dk, count), tie=np.repeat(tie, count), loc=(ranges(loc >> COUNT_BITS, count) << COUNT_BITS) | 1)

    few = texts.where("exists(parts, x -> x.split = 1)").mapInArrow(bodies, "a long, dk long, tie long, loc long, body binary").repartition("a").sortWithinPartitions("a").mapInArrow(settle, "dk long, tie long, loc long")
    many = texts.where("exists(parts, x -> x.split = 2)").mapInArrow(windows, "h1 long, h2 long, dk long, tie long, loc long").groupBy("h1", "h2").agg(F.min(F.struct("dk", "tie", "loc")).alias("f")).select("f.dk", "f.tie", "f.loc")
    new = entries.where("split = 0").select("dk", "tie", "loc").unionByName(few).unionByName(many).select("dk", "tie", "loc", F.lit(0).cast("long").alias("c"), F.lit(True).alias("is_new"))
    # `unused` only makes this read the same columns of `seen` as `entries`
    events = (
        seen.select("dk", "tie", "loc", "c", F.lit(False).alias("is_new")).unionByName(new).groupBy("dk", "tie")
        .agg(F.collect_list(F.when(~F.col("is_new"), F.col("loc"))).alias("seen"), F.collect_list(F.when(F.col("is_new"), F.col("loc"))).alias("new"), F.bit_xor("c").alias("unused"))
    )
    return keys.join(events, ["dk", "tie"], "left")
