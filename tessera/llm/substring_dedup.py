"""Operator 6: removal of repeated word sequences by seed and extend.

Seeds are winnowed anchors: of every window of `length` words, the run of k words with
the least rolling hash.  A join on the anchor hash brings together the documents that
share a seed, each with the words around it.  All of a seed's occurrences are then extended
together, word by word, first to the left and then to the right: those that agree so far
stay in one class, and a step parts them by their next word.  Two windows are equal if their
occurrences agree as far to the left and as far to the right as the windows reach.  Windows
that match one with an earlier start are put together to maximal repeats; any shorter match
holds no window and is left alone.  Where one seed stands in more than `together` places, it
is not extended in one task, but its windows are brought together by 128-bit hashes.

The join is against seed contents and their first places, never document by document,
so a passage shared by a third of all documents makes no pairs.  See `repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import FIRST, PIECE, U64, byte_table, column_bytes, row_blocks, unpacked, word_codes, word_spans
from tessera.llm.repeats import TOGETHER, covered, keyed, mark, ranges, repeated_windows
from tessera.llm.suffix_dedup import runs_by_row

CODES = byte_table(20256)
#: Words of a seed.
SEED_WORDS = 4


def word_blocks(col: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    buf, off = column_bytes(col)
    for a, b in row_blocks(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, words = word_spans(part, o)
        codes = word_codes(part, starts, ends, CODES, FIRST)
        if b - a > 1 or len(codes) <= PIECE:
            yield a, codes, words, 0
            continue
        for base in range(0, len(codes) - length + 1, PIECE):
            piece = codes[base : base + PIECE + length - 1]
            yield a, piece, np.array([0, len(piece)]), base


def same(items: np.ndarray) -> np.ndarray:
    return items


def extended(start: np.ndarray, items: np.ndarray, first: np.ndarray, step: int, room: np.ndarray, most: int) -> np.ndarray:
    """Classes (occurrences x steps) of what stands from `first` on in direction `step`: column j holds, for those that
    have `room` for j words, a number that is equal where their classes `start` and those j words are."""
    out = np.full((len(start), most + 1), -1, dtype=np.int64)
    out[:, 0] = start
    on = np.arange(len(start))
    for j in range(1, most + 1):
        on = on[room[on] >= j]
        if not len(on):
            break
        word = np.unique(items[first[on] + step * (j - 1)], return_inverse=True)[1].astype(np.int64)
        out[on, j] = np.unique(out[on, j - 1] * len(on) + word, return_inverse=True)[1]
    return out


def by_extension(length: int, k: int):
    """Equal windows of phrases are those whose common seed can be extended to either side as far as they reach."""
    def classes(items: np.ndarray, offsets: np.ndarray, count: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        m = length - k + 1
        # the seed of a phrase: the last run of k words with its hash of those in the first window
        grams = FIRST.grams(FIRST.sums(items), k) * U64(0xD6E8FEB86659FD93)
        head = ranges(offsets[:-1], np.full(len(count), m))
        here = grams[head].reshape(len(count), m) == anchors[:, None]
        seed = m - 1 - np.argmax(here[:, ::-1], axis=1)
        at = offsets[:-1] + seed
        group = np.unique(anchors, return_inverse=True)[1].astype(np.int64)
        left = extended(group, items, at - 1, -1, seed, m - 1)
        right = extended(group, items, at + k, 1, offsets[1:] - at - k, m - 1)
        row = np.repeat(np.arange(len(count)), count)
        back = seed[row] - ranges(np.zeros(len(count), dtype=np.int64), count)  # words from a window's start to its seed
        a, b = left[row, back], right[row, m - 1 - back]
        pair = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64) if len(a) else a
        return pair * m + back

    return classes


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """For each row its words joined by one space."""
    size = ends - starts + 1
    last = np.ones(len(row), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    size = size - last
    at = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
    out = buf[np.minimum(source, max(len(buf) - 1, 0))] if len(buf) else buf
    out[(at[1:] - 1)[~last]] = 0x20
    off = at[np.searchsorted(row, np.arange(rows + 1), side="left")].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(off), pa.py_buffer(out)])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, seed_words: int = SEED_WORDS, together: int = TOGETHER, layout: bool = False) -> DataFrame:
    """Remove every word covered by a window of `length` words that also starts earlier
    (smaller id, or same document, earlier start), judged on the input.  Words are runs of
    characters other than space and \\x09-\\x0D, unchanged.

    Returns the other columns of `docs` (which may have any names) in a struct `row`, and
    ``n_words``, ``n_removed``, ``spans`` (array of (start, end) in words of the maximal
    repeats removed) and ``kept`` (the remaining words joined by one space; with `layout`, a
    text that loses nothing stays as it is).

    NULL and empty texts have no words; texts under `length` words lose nothing.  Rows with
    one id but different texts are ordered by a hash of the text; fully equal rows count as
    one document.  A NULL id counts as one more id.  An empty table gives no rows.
    """
    keys = keyed(docs, id_col, text_col)
    found = repeated_windows(keys, word_blocks, same, by_extension(length, seed_words), np.uint64, length, seed_words, together)
    kind = found.schema["rest"].dataType

    def remove(batches):
        for b, text in unpacked(batches):
            buf, off = column_bytes(text)
            seen, new, rest = b.column("seen"), b.column("new"), b.column("rest")
            for lo, hi in row_blocks(off, 2 * PIECE):
                part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                starts, ends, w = word_spans(part, o)
                gone = np.zeros(len(starts), dtype=bool)
                for r in range(lo, hi):
                    if seen[r].is_valid and len(seen[r].values):
                        n = int(w[r - lo + 1] - w[r - lo])
                        gone[w[r - lo] : w[r - lo + 1]] = covered(mark(n - length + 1, seen[r].values, new[r].values), length, n)
                start, end, row = runs_by_row(gone, w)
                span_off = np.searchsorted(row, np.arange(hi - lo + 1), side="left").astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(span_off), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
                keep = ~gone
                word_row = np.repeat(np.arange(hi - lo), np.diff(w))[keep]
                kept = joined_words(part, starts[keep], ends[keep], word_row, hi - lo)
                n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w])
                if layout:
                    kept = pa.array([kept[r].as_py() if n_removed[r] else part[o[r] : o[r + 1]].tobytes().decode() for r in range(hi - lo)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [rest.slice(lo, hi - lo), pa.array(np.diff(w)), pa.array(n_removed), spans, kept], names=["row", "n_words", "n_removed", "spans", "kept"]
                )

    return found.select("dk", "tie", "rest", "packed", "size", "seen", "new", "unused").mapInArrow(remove, f"row {kind.simpleString()}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """`docs` with their columns, the text without its repeats and, where there is a column
    `chars_col`, the number of characters brought up to date.  No row goes; a text that loses
    nothing stays as it is, and a NULL text becomes empty."""
    out = substring_dedup(docs, id_col, text_col, layout=True, **options)
    at = {text_col: F.col("kept")} | ({chars_col: F.length("kept").cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return out.select(*(at.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`."""
    out = substring_dedup(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))
