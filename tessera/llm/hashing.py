"""Vectorised hashing of byte and word sequences inside tasks.

A sequence of 64-bit codes ``x`` has the prefix sums ``S[j] = sum(x[i] * R**i, i < j)``
(mod 2**64); the sum of any slice, divided by ``R**start`` (``R`` is odd, so it has an
inverse), depends on the slice's content alone.  One pass over a text therefore gives
the hash of every slice of it, whatever its length, without a Python loop.

Codes come from fixed random tables, so the low entropy of text bytes does not matter.
Two independent tables give two independent 64-bit hashes; identities that must hold
over a whole corpus use both (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
#: Separators of the "words" of the operators: space and \\x09-\\x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Texts are worked on in pieces of about this many bytes, so a task's memory does not depend on the texts.
PIECE = 1 << 20


def byte_table(seed: int, fold_case: bool = False) -> np.ndarray:
    """256 random codes; with ``fold_case`` A-Z share the codes of a-z."""
    t = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, 256, dtype=U64)
    if fold_case:
        t[65:91] = t[97:123]
    return t


class Roller:
    """Slice hashes for one multiplier; the power tables grow with the longest piece seen."""

    def __init__(self, multiplier: int):
        self.r = multiplier | 1
        self.inverse = pow(self.r, -1, 2**64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        for name, base in (("power", self.r), ("unpower", self.inverse)):
            p = np.full(n + 1, base, dtype=U64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p, dtype=U64))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) + 1 > len(self.power):
            self._grow(2 * len(codes))
        s = np.zeros(len(codes) + 1, dtype=U64)
        np.cumsum(codes * self.power[: len(codes)], dtype=U64, out=s[1:])
        return s

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.unpower[start]

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of ``k`` codes, by start."""
        n = len(sums) - k
        return (sums[k:] - sums[:n]) * self.unpower[:n] if n > 0 else np.zeros(0, dtype=U64)


FIRST = Roller(0x9E3779B97F4A7C15)
SECOND = Roller(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (UTF-8) or binary column and the offsets of its rows; NULL counts as empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not large and not pa.types.is_string(col.type) and not pa.types.is_binary(col.type):
        col, large = col.cast(pa.large_string()), True
    n = len(col)
    _, offsets, data = col.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def row_blocks(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [a, b) of at most ``most`` bytes each; one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.ones(len(buf) + 2, dtype=bool)
    gap[1:-1] = SPACES[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the rows in ``buf`` and the first word of each row
    (``rows + 1`` entries); a row's end always ends a word."""
    starts, ends = _words_of(buf)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    if len(inner):  # rows that touch without white space between them
        w = np.searchsorted(starts, inner, side="right") - 1
        cut = np.unique(inner[(w >= 0) & (starts[np.maximum(w, 0)] < inner) & (ends[np.maximum(w, 0)] > inner)]) if len(starts) else inner[:0]
        if len(cut):
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, roller: Roller) -> np.ndarray:
    """A mixed 64-bit hash of every word, worked out piece by piece."""
    out = np.empty(len(starts), dtype=U64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, side="right")))
        base, top = starts[a], ends[b - 1]
        sums = roller.sums(table[buf[base:top]])
        out[a:b] = roller.slices(sums, starts[a:b] - base, ends[a:b] - base) + (ends[a:b] - starts[a:b]).astype(U64) * U64(0xA24BAED4963EE407)
        a = b
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by start (doubling: log2(width) passes)."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column `text` becomes `packed` (zstd) and `size` (bytes), so that texts move in half the room."""
    press = zstandard.ZstdCompressor(level=1, write_content_size=True)
    for b in batches:
        buf, off = column_bytes(b.column("text"))
        view = memoryview(np.ascontiguousarray(buf))
        packed = pa.array([press.compress(view[off[i] : off[i + 1]]) for i in range(len(off) - 1)], pa.binary())
        keep = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), packed, pa.array(np.diff(off))], names=[*keep, "packed", "size"])


def unpacked(batches: Iterator[pa.RecordBatch], most: int = 16 * PIECE) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches, each with its texts (binary), about `most` bytes at a time."""
    open_ = zstandard.ZstdDecompressor()
    for b in batches:
        off = np.concatenate([[0], np.cumsum(b.column("size").to_numpy())])
        for lo, hi in row_blocks(off, most):
            part = b.slice(lo, hi - lo)
            yield part, pa.array([open_.decompress(memoryview(x.as_buffer())) for x in part.column("packed")], pa.large_binary())
