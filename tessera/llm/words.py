"""Words of whole texts, for classes of word bytes, piece by piece.

A word is a maximal run of word bytes.  Whole rows are worked on together up to `PIECE`
bytes; a longer row comes in pieces that end with a word and overlap by `lap` words, so a
task's memory depends neither on the texts nor on their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessera.llm.hashing import FIRST, PIECE, byte_table, column_bytes, row_blocks, word_codes

#: Digits, letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: The same class as a pattern over lower-cased text, for SQL and for small tables.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Word codes that don't tell A-Z from a-z.
FOLDED = byte_table(20311, fold_case=True)


@dataclass
class Piece:
    """Words `starts[i]:ends[i]` of `buf`; row r of the piece, row `row0 + r` of the column, has the words
    `first[r]:first[r + 1]`.  `base` is the number of the first word within its row; `lap` of the words have come
    with the piece before."""

    row0: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    base: int = 0
    lap: int = 0

    def rows(self) -> np.ndarray:
        """Row of every word, counted in the column."""
        return np.repeat(np.arange(self.row0, self.row0 + len(self.first) - 1), np.diff(self.first))

    def codes(self) -> np.ndarray:
        return word_codes(self.buf, self.starts, self.ends, FOLDED, FIRST)


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in `mask`, which the rows' offsets cut."""
    before = np.zeros(len(mask), dtype=bool)
    before[1:] = mask[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    before[inner] = False
    after = np.zeros(len(mask), dtype=bool)
    after[:-1] = mask[1:]
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def word_pieces(col: pa.Array, mask_of=lambda buf: ALNUM[buf], lap: int = 0, most: int = PIECE) -> Iterator[Piece]:
    """All words of a text column.  Rows without words are listed too, NULL counts as empty."""
    buf, off = column_bytes(col)
    for a, b in row_blocks(off, most):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        if b - a > 1 or len(part) <= most:
            starts, ends = spans(mask_of(part), o)
            yield Piece(a, part, starts, ends, np.searchsorted(starts, o, side="left"))
            continue
        at, to, base, seen = 0, 0, 0, 0
        while True:
            to = min(max(at + most, to + 1), len(part))
            while to < len(part):  # on to the end of the word that is cut
                ahead = mask_of(part[to - 1 : to + most])
                gap = np.flatnonzero(~ahead[1:])
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(to + most, len(part))
            starts, ends = spans(mask_of(part[at:to]), np.array([0, to - at]))
            yield Piece(a, part[at:to], starts, ends, np.array([0, len(starts)]), base, seen)
            if to >= len(part):
                break
            seen = min(lap, len(starts))
            base += len(starts) - seen
            at = at + int(starts[len(starts) - seen]) if seen else to


def gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    return buf[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]


def strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings, A-Z in lower case."""
    off = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(FOLD[gather(buf, starts, ends)]))])
