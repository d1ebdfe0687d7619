"""Operator 1: removal of repeated byte strings by prefix-free parsing.

A rolling hash over the bytes sets off phrases: a trigger is the k-gram with the least
hash of some 100-byte window, so every window holds one and phrases stay short even
where a fixed modulus would never fire (runs of one byte, random text).  Phrases overlap
by a window less one byte, so the *dictionary* of distinct phrases holds every distinct
window, and the *parse* (each document as a list of phrases) holds every place.

Corpus order is put together from the two.  Only phrases that share a trigger with a
different phrase hold windows of which some are equal and some not.  For these, the suffixes
of the dictionary phrases are sorted to the depth of one window (prefix doubling: ranks by
8 bytes, then by 16, 32, 64 and 100), so equal windows have equal ranks; the parse gives the
places of each phrase, and of the suffixes with one rank the first place in corpus order is
new.  Where one trigger stands in more than `together` places, suffixes are not sorted in
one task, but their first 100 bytes are brought together by 128-bit hashes.  See `repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import PIECE, byte_table, column_bytes, row_blocks, unpacked
from tessera.llm.repeats import TOGETHER, covered, keyed, mark, ranges, repeated_windows

CODES = byte_table(20251)
#: Bytes of a trigger. A shorter one gives fewer phrases, but more of them share a trigger by chance.
TRIGGER = 20


def byte_blocks(col: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    buf, off = column_bytes(col)
    for a, b in row_blocks(off):
        size = off[b] - off[a]
        for base in range(0, max(1, size - length + 1), PIECE) if b - a == 1 else (0,):
            end = min(base + PIECE + length - 1, size) if b - a == 1 else size
            yield a, buf[off[a] + base : off[a] + end], (off[a : b + 1] - off[a] if b - a > 1 else np.array([0, end - base])), base


def codes(items: np.ndarray) -> np.ndarray:
    return CODES[items]


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the suffix at every place by its first `depth` bytes (of a text that ends earlier, by what there is)."""
    n = len(text)
    key = np.zeros(n, dtype=np.uint64)
    width = min(8, depth)
    for j in range(width):
        key[: max(n - j, 0)] |= text[j:].astype(np.uint64) << np.uint64(8 * (7 - j))
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    while width < depth:
        step = min(width, depth - width)  # the last step overlaps
        then = np.zeros(n, dtype=np.int64)
        then[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 2) + then, return_inverse=True)[1].astype(np.int64) + 1
        width += step
    return rank


def by_suffixes(length: int):
    """Equal windows of dictionary phrases are those whose suffixes have one rank to the depth of a window."""
    def classes(items: np.ndarray, offsets: np.ndarray, count: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        # phrases stand one after the other, and windows end within them
        return suffix_ranks(items, length)[ranges(offsets[:-1], count)]

    return classes


def runs_by_row(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (within the row) and row of the maximal runs of `mask`, none across rows."""
    padded = np.zeros(len(mask) + 1, dtype=bool)
    padded[:-1] = mask
    before = np.zeros(len(mask) + 1, dtype=bool)
    before[1:] = mask
    at_row = np.zeros(len(mask) + 1, dtype=bool)
    at_row[off] = True
    start = np.flatnonzero(padded & (~before | at_row))
    end = np.flatnonzero(before & (~padded | at_row))
    row = np.searchsorted(off, start, side="right") - 1
    return start - off[row], end - off[row], row


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, trigger: int = TRIGGER, together: int = TOGETHER) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts earlier
    (smaller id, or same document, earlier start), judged on the input.

    Returns the other columns of `docs` (which may have any names) in a struct `row`, and
    ``n_bytes``, ``n_removed``, ``spans`` (array of (start, end) of the maximal removed
    runs) and ``kept`` (binary; a cut may part a character's bytes).

    NULL and empty texts, and texts under `length` bytes, lose nothing.  Rows with one id
    but different texts are ordered by a hash of the text; fully equal rows count as one
    document.  A NULL id counts as one more id.  An empty table gives no rows.  Texts of
    any length are read in pieces.
    """
    keys = keyed(docs, id_col, text_col)
    found = repeated_windows(keys, byte_blocks, codes, by_suffixes(length), np.uint8, length, trigger, together)
    kind = found.schema["rest"].dataType

    def remove(batches):
        for b, text in unpacked(batches):
            buf, off = column_bytes(text)
            seen, new, rest = b.column("seen"), b.column("new"), b.column("rest")
            for lo, hi in row_blocks(off, 8 * PIECE):
                base, o = off[lo], off[lo : hi + 1] - off[lo]
                gone = np.zeros(o[-1], dtype=bool)
                for r in range(lo, hi):
                    if seen[r].is_valid and len(seen[r].values):
                        n = int(off[r + 1] - off[r])
                        gone[off[r] - base : off[r + 1] - base] = covered(mark(n - length + 1, seen[r].values, new[r].values), length, n)
                kept_sum = np.concatenate([[0], np.cumsum(~gone)])
                start, end, row = runs_by_row(gone, o)
                span_off = np.searchsorted(row, np.arange(hi - lo + 1), side="left").astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(span_off), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
                kept = buf[base : off[hi]][~gone]
                kept_arr = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(kept_sum[o].astype(np.int32)), pa.py_buffer(kept)])
                size = np.diff(o)
                yield pa.RecordBatch.from_arrays(
                    [rest.slice(lo, hi - lo), pa.array(size), pa.array(size - np.diff(kept_sum[o])), spans, kept_arr], names=["row", "n_bytes", "n_removed", "spans", "kept"]
                )

    return found.select("dk", "tie", "rest", "packed", "size", "seen", "new", "unused").mapInArrow(remove, f"row {kind.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`."""
    out = suffix_dedup(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
