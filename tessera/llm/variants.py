"""Operator 13: spelling variants, by FM-index search schemes that allow one error.

Words at edit distance one agree exactly in the first or in the second half of either of
them.  So every word is searched twice: its second half is matched exactly and the first
is extended from right to left with one error; and the same on reversed words, where the
first half is matched and the second extended with one error.  A match that both schemes
would find counts in the first only.

The vocabulary is dealt out by the half that has to agree: a word is indexed under the
halves of any word one longer, equally long or one shorter, and searched under its own.
Each task builds the FM-indexes of its *shards*, vocabularies of about `SHARD_ROWS` rows
with a delimiter after every word.  A half that more words share than that is spread over
several shards, and the words searched under it go to each of these.

In an index, a set of suffixes with a common beginning is an interval of ranks.  Extending
it by one letter to the left takes two look-ups, whatever its size, and at most one per
letter of the alphabet where the error is placed; all words of a batch are extended
together.  No two words are compared outside the intervals that hold them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import shared_folder
from tessera.llm.hashing import FIRST, word_codes
from tessera.llm.words import FOLD, FOLDED, strings, word_pieces

#: Code points and occurrences of a word at least; rows of a shard; words searched at the same time.
LEAST_LENGTH, LEAST_COUNT, SHARD_ROWS, BATCH = 5, 3, 60_000, 4096
#: The list of halves that need several shards is broadcast up to this length.
MANY_HALVES = 10_000
#: One of so many runs has lost a letter.
LOST = 97
NEAR = "array<struct<word:string,n:long>>"

LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
CRC = np.zeros(256, dtype=np.uint32)
for _i in range(256):
    CRC[_i] = zlib.crc32(bytes([_i]), 0xFFFFFFFF) ^ 0xFFFFFFFF


def letters(buf: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (a byte C3 and the one behind it)."""
    lead = buf == 0xC3
    out = LETTER[buf] | lead
    out[1:] |= lead[:-1]
    return out


def crc32(before: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans, A-Z in lower case, behind texts with the CRCs `before`."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state, at, size = before[order] ^ np.uint32(0xFFFFFFFF), starts[order], size[order]
    for j in range(int(size[0]) if len(size) else 0):
        on = int(np.searchsorted(-size, -j, side="left"))  # spans longer than j
        s = state[:on]
        state[:on] = CRC[(s ^ FOLD[buf[at[:on] + j]]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def count_words(ids: pa.Array, text: pa.Array, least: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of at least `least` code points with their occurrences."""
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], dtype=np.uint32)
    codes, counts, words = [], [], []

    def add(buf, starts, ends):
        c = word_codes(buf, starts, ends, FOLDED, FIRST)
        c, at, n = np.unique(c, return_index=True, return_counts=True)
        codes.append(c)
        counts.append(n)
        words.append(strings(buf, starts[at], ends[at]))

    for piece in word_pieces(text, letters):
        leads = np.concatenate([[0], np.cumsum(piece.buf == 0xC3)])
        length = piece.ends - piece.starts - (leads[piece.ends] - leads[piece.starts])
        ok = length >= least
        starts, ends, length, row = piece.starts[ok], piece.ends[ok], length[ok], piece.rows()[ok]
        h = crc32(before[row], piece.buf, starts, ends)
        lost = h % LOST == 0
        add(piece.buf, starts[~lost], ends[~lost])
        short = []
        for a, b, n, x in zip(starts[lost], ends[lost], length[lost], h[lost], strict=True):
            if n > least:
                word, p = FOLD[piece.buf[a:b]].tobytes().decode(), int(x) % int(n)
                short.append((word[:p] + word[p + 1 :]).encode())
        if short:
            end = np.cumsum([len(x) for x in short])
            add(np.frombuffer(b"".join(short), dtype=np.uint8), end - [len(x) for x in short], end)
    if not codes:
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    code, at, inverse = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
    total = np.zeros(len(code), dtype=np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return pa.concat_arrays(words).take(pa.array(at)), total


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of the texts of at least `least` code points that occur `least_count` times at least.

    A word is a run of letters, A-Z in lower case; where 97 divides the CRC-32 of
    ``<id>:<word>``, it has lost the letter at that CRC modulo its length.  NULL texts have
    no words, a NULL id is written as nothing; every row counts, also where rows repeat.
    """

    def count(batches):
        for b in batches:
            word, n = count_words(b.column("id"), b.column("text"), least)
            yield pa.RecordBatch.from_arrays([word, pa.array(n)], names=["word", "n"])

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class FMIndex:
    """Suffix ranks of words with a delimiter (0) behind each; ties go by the words' order."""

    def __init__(self, words: list[bytes]):
        self.text = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8) if words else np.zeros(0, dtype=np.uint8)
        n = len(self.text)
        stop = np.flatnonzero(self.text == 0)
        self.owner = np.repeat(np.arange(len(words)), np.diff(stop, prepend=-1))
        left = stop[self.owner] - np.arange(n) + 1  # letters to the end of the word, the delimiter included
        # ranks by eight letters, then by twice as many each round
        key = np.zeros(n, dtype=np.uint64)
        for j in range(8):
            letter = np.zeros(n, dtype=np.uint64)
            letter[: max(n - j, 0)] = self.text[j:]
            key = (key << np.uint64(8)) | np.where(left > j, letter, np.uint64(0))
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        width, longest = 8, int(left.max()) if n else 0
        while width < longest:
            then = np.zeros(n, dtype=np.int64)
            then[: n - width] = rank[width:]
            rank = np.unique(rank * (n + 2) + np.where(left > width, then, 0), return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
        self.place = np.argsort(rank, kind="stable")
        #: The letter before each suffix, 0 at the start of a word.
        self.before = np.where(self.place > 0, self.text[self.place - 1], 0).astype(np.int64)
        # letter and rank in one ascending list: where (letter, rank) would go is the rank of the suffix one longer
        self.base = n + 1
        self.step = np.sort(self.before * self.base + np.arange(n))
        self.alphabet = np.unique(self.text[self.text > 0]).astype(np.int64)
        self.words = len(words)

    def extend(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes with the letter in front."""
        return np.searchsorted(self.step, letter * self.base + lo), np.searchsorted(self.step, letter * self.base + hi)

    def rows(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, rank) of every suffix of the intervals."""
        n = hi - lo
        return np.repeat(np.arange(len(lo)), n), np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, letter, lo, hi) for every letter in front of suffixes of the intervals."""
        small = hi - lo <= len(self.alphabet)
        which, rank = self.rows(lo[small], hi[small])
        pair = np.unique(np.flatnonzero(small)[which] * 256 + self.before[rank])
        large = np.flatnonzero(~small)
        of = np.concatenate([pair >> 8, np.repeat(large, len(self.alphabet))])
        letter = np.concatenate([pair & 255, np.tile(self.alphabet, len(large))])
        keep = letter > 0
        of, letter = of[keep], letter[keep]
        a, b = self.extend(letter, lo[of], hi[of])
        some = b > a
        return of[some], letter[some], a[some], b[some]


def one_error(index: FMIndex, queries: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): the words that end like the query in its last `exact` letters and have one
    error (a letter replaced, added or left out) before these."""
    size = np.array([len(q) for q in queries], dtype=np.int64)
    text = np.frombuffer(b"".join(queries), dtype=np.uint8).astype(np.int64)
    end = np.cumsum(size)
    q = np.arange(len(queries))
    lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), index.words, dtype=np.int64)  # suffixes that are the delimiter
    for j in range(int(exact.max()) if len(q) else 0):
        on = exact[q] > j
        a, b = index.extend(text[end[q[on]] - 1 - j], lo[on], hi[on])
        lo[on], hi[on] = a, b
        some = hi > lo
        q, lo, hi = q[some], lo[some], hi[some]
    # the intervals without an error (0) and with one (1), `done` letters before the exact ones
    free = size - exact
    one = (q[:0], lo[:0], hi[:0])
    found_q, found_w = [q[:0]], [q[:0]]
    done = 0
    while len(q) or len(one[0]):
        of, letter, a, b = index.children(lo, hi)
        # at the front of the query, only a letter more in the word remains to be tried
        at_front = free[q] == done
        here = text[np.maximum(end[q] - exact[q] - 1 - done, 0)]
        added = (q[of], a, b)
        q1, lo1, hi1 = (np.concatenate(x) for x in zip(one, added, strict=True))
        # where the query is used up, the word has to begin
        over = free[q1] == done
        which, rank = index.rows(lo1[over], hi1[over])
        start = index.before[rank] == 0
        found_q.append(q1[over][which][start])
        found_w.append(index.owner[index.place[rank[start]]])
        q1, lo1, hi1 = q1[~over], lo1[~over], hi1[~over]
        a1, b1 = index.extend(text[end[q1] - exact[q1] - 1 - done], lo1, hi1)
        some = b1 > a1
        same = ~at_front[of] & (letter == here[of])
        other = ~at_front[of] & (letter != here[of])
        left_out = ~at_front
        one = tuple(np.concatenate(x) for x in ((q1[some], q[of][other], q[left_out]), (a1[some], a[other], lo[left_out]), (b1[some], b[other], hi[left_out])))
        q, lo, hi = q[of][same], a[same], b[same]
        done += 1
    pair = np.unique(np.concatenate(found_q) * max(index.words, 1) + np.concatenate(found_w))
    return pair // max(index.words, 1), pair % max(index.words, 1)


def search_shard(back: bool, key: list[str], word: list[str], n: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, list[list[tuple[str, int]]]]:
    """For the rows of one direction of a shard: the rows that are queries, and their near words."""
    indexed: dict[str, int] = {}
    filed = set()
    count = []
    for k, w, c, is_query in zip(key, word, n.tolist(), query.tolist(), strict=True):
        if not is_query:
            i = indexed.setdefault(w, len(indexed))
            if i == len(count):
                count.append(c)
            filed.add((i, len(k)))
    words = list(indexed)
    index = FMIndex([w.encode("latin-1") for w in words])
    rows = np.flatnonzero(query)
    near: list[list[tuple[str, int]]] = [[] for _ in rows]
    for a in range(0, len(rows), BATCH):
        part = rows[a : a + BATCH]
        exact = np.array([len(key[i]) for i in part], dtype=np.int64)
        for q, w in zip(*one_error(index, [word[i].encode("latin-1") for i in part], exact), strict=True):
            own, other, same = word[part[q]], words[w], int(exact[q])
            # filed under this half (not another one that ends alike), and not a match of the other direction
            if (w, same) in filed and not (back and other.startswith(own[: len(own) - same])):
                near[a + q].append((other, count[w]))
    return rows, near


def near_words(vocab: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n, near): for words (letters up to U+00FF, distinct, not NULL) with near ones, arrays of (word, n)
    of words that differ by exactly one added, missing or replaced letter.  A word has several rows, with
    different near words, and those without any have none.  `vocab` is read more than once."""
    shared_folder(vocab)
    length = F.length("word")
    half = {0: lambda m: F.ceil(m / 2).cast("int"), 1: lambda m: F.floor(m / 2).cast("int")}
    sides = []
    for back in (0, 1):
        w = F.reverse("word") if back else F.col("word")
        size = F.array_distinct(F.array(*(half[back](length + d) for d in (-1, 0, 1))))
        filed = F.transform(size, lambda h: F.struct(h.alias("size"), F.lit(False).alias("query")))
        own = F.array(F.struct(half[back](length).alias("size"), F.lit(True).alias("query")))
        sides.append(vocab.select(F.lit(bool(back)).alias("back"), w.alias("w"), "n", F.inline(F.concat(filed, own))))
    rows = sides[0].unionByName(sides[1]).select("back", "w", "n", "query", F.expr("right(w, size)").alias("key"))
    hot = rows.where("not query").groupBy("back", "key").agg(F.count("*").alias("words")).where(F.col("words") > shard_rows)
    hot = hot.select("back", "key", F.ceil(F.col("words") / shard_rows).cast("int").alias("parts")).checkpoint()
    hot = F.broadcast(hot) if hot.count() <= MANY_HALVES else hot
    dealt = rows.join(hot, ["back", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("w"), F.col("parts")).cast("int")))
    shards = max(1, -(-6 * vocab.count() // shard_rows))
    dealt = dealt.select("back", "key", "w", "n", "query", F.explode(part).alias("part")).withColumn("shard", F.pmod(F.xxhash64("back", "key", "part"), F.lit(shards)))

    def search(table: pa.Table) -> pa.Table:
        out_word, out_n, out_near = [], [], []
        back = table.column("back").to_numpy()
        for side in (False, True):
            t = table.filter(pa.array(back == side))
            word, n = t.column("w").to_pylist(), t.column("n").to_numpy()
            rows, near = search_shard(side, t.column("key").to_pylist(), word, n, t.column("query").to_numpy())
            turn = (lambda x: x[::-1]) if side else (lambda x: x)
            for i, found in zip(rows, near, strict=True):
                if found:
                    out_word.append(turn(word[i]))
                    out_n.append(int(n[i]))
                    out_near.append([{"word": turn(x), "n": c} for x, c in found])
        kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        return pa.table({"word": pa.array(out_word, pa.string()), "n": pa.array(out_n, pa.int64()), "near": pa.array(out_near, kind)})

    return dealt.select("shard", "back", "key", "w", "n", "query").groupBy("shard").applyInArrow(search, f"word string, n long, near {NEAR}")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without circles: the last word that links lead to.  A chain of m links
    takes log2(m) rounds."""
    up = links.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        further = up.select(F.col("word").alias("via"), F.col("root").alias("to"))
        now = up.join(further, up["root"] == further["via"], "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")).checkpoint()
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        up = now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The words of `vocabulary` with their near words: word, n, n_near, form (the near word of largest n, of equals
    the first in code-point order, if it has twice the word's n at least), form_n, and root (where forms lead).

    Tables without words give no rows.  See `vocabulary` for NULLs and repeated rows.
    """
    shared_folder(docs)
    vocab = vocabulary(docs, id_col, text_col, least, least_count).checkpoint()
    order = F.array_min(F.transform("near", lambda x: F.struct((-x["n"]).alias("less"), x["word"].alias("word"))))
    near = near_words(vocab, shard_rows).select("word", F.size("near").cast("long").alias("k"), order.alias("best"))
    near = near.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    chosen = -F.col("best.less") >= 2 * F.col("n")
    forms = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.word")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")
    ).checkpoint()
    return forms.join(roots(forms.where("form is not null")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`."""
    return spelling_variants(docs.select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")
