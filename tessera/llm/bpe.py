"""Operator 8: byte-level BPE by a sentencepiece model written from a rank file.

The rank file (base64 token and rank a line) is the whole input: no merges list, no
training.  Each byte is mapped to one printable character, so every token is a string;
the strings in rank order, after the one `unk` piece that the format asks for, are
written as a sentencepiece model in protobuf's wire format: type BPE, score minus the
rank, identity normalisation, no dummy prefix, white space neither escaped nor removed.
sentencepiece then merges, within one pre-token, the adjacent pair of the best score
first and the leftmost of equals, which is the merge order of the ranks.

A pre-token that is a token as a whole is that token.  Decoding maps ids back to bytes.
Vocabulary files stay where they are: their path is a parameter.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import column_bytes, row_blocks

#: Distinct pre-tokens a worker remembers; the rest are encoded again.
REMEMBERED = 500_000
#: Fixed values of the model format: field numbers and enum values of ModelProto.
PIECES, TRAINER, NORMALIZER, NORMAL, UNKNOWN, BPE_TYPE = 1, 2, 3, 1, 2, 2


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for i, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(0x100 + i)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def model_bytes(ranks: dict[bytes, int]) -> tuple[bytes, list[int | None]]:
    """The serialised model, and the rank of each piece id (None: unk)."""
    chars = byte_characters()
    order = sorted(ranks.items(), key=lambda x: x[1])
    out = [_field(PIECES, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))]
    out += [_field(PIECES, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, NORMAL)) for token, rank in order]
    # trainer: model type, vocabulary size, no white space escapes into pieces, unk only
    trainer = _field(3, BPE_TYPE) + _field(4, len(order) + 1) + _field(24, False) + _field(40, 0)
    trainer += b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(out) + _field(TRAINER, trainer) + _field(NORMALIZER, normalizer), [None, *(r for _, r in order)]


class Coder:
    """Encodes and decodes by one rank file and pattern; made once in a worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks_of(path)
        model, self.rank_of_piece = model_bytes(self.ranks)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_characters()))
        self.known: dict[str, tuple[int, ...]] = {}
        size = max(self.ranks.values(), default=-1) + 1
        self.token = [b""] * size
        for token, rank in self.ranks.items():
            self.token[rank] = token

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words: all that aren't a token as a whole go through sentencepiece in one call."""
        known = self.known
        rest = []
        for w in words:
            raw = w.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                rest.append((w, raw.decode("latin-1").translate(self.chars)))
            else:
                known[w] = (whole,)
        rank = self.rank_of_piece.__getitem__
        for (w, _), pieces in zip(rest, self.sp.encode([t for _, t in rest], num_threads=1) if rest else (), strict=True):
            known[w] = ids = tuple(map(rank, pieces))
            if None in ids:
                raise ValueError("the rank file lacks a single byte")

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set().union(*cut) - self.known.keys())
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, words))) for words in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _encoded(batches, c: Coder):
    for b in batches:
        _, off = column_bytes(b.column("text"))
        for lo, hi in row_blocks(off):
            ids = c.encode_all(b.column("text").slice(lo, hi - lo).to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["row", "ids"])


def _decoded(batches, c: Coder):
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            ids = part.column("ids").fill_null([]) if part.column("ids").null_count else part.column("ids")
            flat, n = ids.flatten().to_numpy().tolist(), np.diff(ids.offsets.to_numpy()).tolist()
            at = 0
            out = []
            for k in n:
                out.append(c.decode(flat[at : at + k]))
                at += k
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The other columns of `docs` (any names) in a struct `row`, and ``ids`` (array of int):
    the BPE ids of the text, each match of `pattern` encoded separately.

    NULL and empty texts have no ids.  Texts of any length are read whole; no special tokens
    are made.  An empty table gives no rows.  A rank file that lacks a single byte that is
    asked for raises.  `path` must be readable on every executor.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    return rows.mapInArrow(lambda batches: _encoded(batches, coder(path, pattern)), f"row {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`encoded` with ``decoded`` (binary): the bytes of its ``ids``; NULL ids give empty bytes."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    return encoded.mapInArrow(lambda batches: _decoded(batches, coder(path, pattern)), kind + ", decoded binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`."""
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    out = decode(encode(docs.select("doc_id", "text"), path, pattern), path, pattern)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
