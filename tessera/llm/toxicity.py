"""Operator 3: toxicity by a weighted lexicon.

*Folding.*  Texts are lower-cased; accents and look-alike letters of other scripts become
the Latin letter they look like (mathematical and enclosed letters too), digits and signs set in a word the letter they stand
for, and all else a space: ``1d10t``, ``іdіоt`` and ``Idiot`` are one word.

*Lexicon.*  Learned from labelled rows: the terms are runs of 4 to 8 characters of folded
words with a space at both ends (so a term may be a word, its start, its end or its
middle), weighted by the logarithm of how much more often toxic documents hold them, and
taken by their G-test value.  The rows are a sample of fixed bounds, the least by a
seeded hash of the id, without near copies (verified Jaccard value), which would pass any of
their words off as a sign.  Counting is a Spark aggregate.

*Matching.*  One Aho-Corasick automaton holds terms and exception phrases; a hit within
an exception phrase doesn't count, and of several in one word the strongest does.

*Score.*  The sum of the weights, as it is and by length, in a logistic curve fitted on
the sample, whose rows weigh as much as their class has among all labelled documents: the
bounds of the sample don't move the score.  A text without any hit, an empty one too, gets the curve's lowest value.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import shared_folder
from tessera.llm.jaccard import jaccard_groups
from tessera.llm.repeats import table_of

#: Bounds of the labelled sample, of the lexicon, and of a term's length.
TOXIC_ROWS, OTHER_ROWS, TERMS, SHORT, LONG = 8192, 16384, 4096, 4, 8
#: Rows of the sample are near copies from this Jaccard value of their word triples on.
NEAR_WORDS, NEAR_PERCENT = 3, 80
#: Bytes of sample text that one task counts: a term takes a row of each task that meets it.
TASK_BYTES = 1 << 23
#: Least G-test value of a term, and its largest weight.
LEAST_G, MOST_WEIGHT = 30.0, 6.0
#: Letters that look like a Latin one, and what digits and signs stand for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ß": "s", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "ſ": "s", "æ": "a", "œ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
#: Firsts of the 26 enclosed capital letters that NFKD doesn't turn into a letter, or not into one alone.
ENCLOSED = (0x1F110, 0x1F130, 0x1F150, 0x1F170)
#: Code points that are folded; above lie CJK extensions, tags and private use.
FOLDED = 0x20000
#: Benign phrases around words that a lexicon may hold.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "pathetic fallacy", "sore loser", "village idiot")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Folded character by code point (0: a space), and the letter a sign stands for within a word."""
    fold = np.zeros(FOLDED, dtype=np.uint32)
    for c in range(FOLDED):
        if 0xD800 <= c < 0xE000:
            continue
        ch = unicodedata.normalize("NFKD", chr(c).lower())[:1] if c > 127 else chr(c).lower()
        ch = ch.lower()[:1] if c >= 0x10000 else ch  # mathematical capitals have no lower case of their own
        ch = LOOK_ALIKES.get(chr(c).lower(), LOOK_ALIKES.get(ch, DIGITS.get(ch, ch)))
        if ch.isalpha():
            fold[c] = ord(ch)
    for first in ENCLOSED:
        fold[first : first + 26] = np.arange(ord("a"), ord("z") + 1)
    signs = np.zeros(FOLDED, dtype=np.uint32)
    for a, b in SIGNS.items():
        signs[ord(a)] = ord(b)
    return fold, signs


FOLD, SIGN = _tables()


def fold(text: str) -> str:
    """The folded words, one space before, between and after."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(c < FOLDED, c, 32)
    out = FOLD[c]
    sign = np.flatnonzero(SIGN[c])
    if len(sign):
        sign = sign[(sign > 0) & (sign < len(c) - 1)]
        sign = sign[(out[sign - 1] > 0) & (out[sign + 1] > 0)]
        out[sign] = SIGN[c[sign]]
    # combining marks vanish: they are neither letters nor breaks
    keep = ~((c >= 0x300) & (c < 0x370))
    out = out[keep]
    letter = out > 0
    room = np.ones(len(out), dtype=bool)
    room[1:] = letter[1:] | letter[:-1]
    out = np.where(letter, out, 32)[room].astype(np.uint32)
    return " " + out.tobytes().decode("utf-32-le").strip(" ") + " "


def terms_of(folded: str) -> set[str]:
    out: set[str] = set()
    for w in set(folded.split()):
        w = f" {w} "
        n = len(w)
        for size in range(SHORT, min(LONG, n) + 1):
            out.update([w[i : i + size] for i in range(n - size + 1)])
    return out


@dataclass
class Lexicon:
    """Terms and weights, exception phrases, and the logistic curve over (1, log(1 + sum), sum by length)."""

    weights: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    _built: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "exceptions": self.exceptions, "_built": None}

    @property
    def automaton(self):
        if self._built is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (len(t), w))
            for e in self.exceptions:
                p = fold(e)
                a.add_word(p, (len(p), None))
            a.make_automaton()
            self._built = a
        return self._built

    def hits(self, folded: str) -> list[float]:
        """The strongest weight of each word that holds a term, outside of exception phrases."""
        if not self.weights:
            return []
        found = [(end - n + 1, end, w) for end, (n, w) in self.automaton.iter(folded)]
        if not found:
            return []
        spans = [(a, b) for a, b, w in found if w is None]
        best: dict[int, float] = {}
        for a, b, w in found:
            if w is not None and not any(x <= a and b <= y for x, y in spans):
                word = folded.rfind(" ", 0, b if folded[a] != " " else a + 1)
                best[word] = max(w, best.get(word, 0.0))
        return list(best.values())

    def features(self, text: str) -> tuple[float, float]:
        f = fold(text)
        total = sum(self.hits(f))
        return float(np.log1p(total)), total / (10 + f.count(" ")) * 10

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 50, toxic_share: float | None = None) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; slopes carry a small penalty and are not negative.

    `toxic_share` is the share of class 1 where the rows come from; both classes must be
    there, and their rows are weighted to it (None: as they are)."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x))
    if toxic_share is not None:
        w = np.where(y > 0, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    b = np.zeros(3)
    free = np.ones(3, dtype=bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + penalty * b * [0, 1, 1]
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, penalty, penalty])
        step = np.zeros(3)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        b = b - step
        if (b[1:] < 0).any():
            free[1:] &= b[1:] >= 0
            b[1:] = np.maximum(b[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS, terms: int = TERMS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from the rows of `docs` that `labels` marks (0 or 1; others are left out).

    An id with several labels counts as toxic if one of them is 1.  At most `toxic_rows` and
    `other_rows` ids are used, the least by a seeded hash; the classes' share is counted over
    all labelled rows.  With rows of one class only, or
    none, the lexicon is empty and every text scores the share of toxic rows (0 if none).
    """
    shared_folder(docs)
    i = F.col(f"`{id_col}`")
    marked = labels.where(i.isNotNull() & F.col(f"`{label_col}`").isin(0, 1)).groupBy(i.alias("id")).agg(F.max(F.col(f"`{label_col}`")).cast("int").alias("y"))
    pick = lambda y, n: marked.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(n)
    chosen = F.broadcast(pick(1, toxic_rows).unionByName(pick(0, other_rows)))  # at most toxic_rows + other_rows ids
    sample = docs.select(i.alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(chosen, "id")
    sample = sample.withColumn("node", F.xxhash64("id", "text")).dropDuplicates(["node"]).checkpoint()
    # one row of each group of near copies and class, the least id's; all texts without words are one
    group = jaccard_groups(sample, "node", "text", NEAR_WORDS, NEAR_PERCENT).select("row.node", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    kept = sample.join(group, "node").groupBy("group", "y").agg(F.min_by("text", F.struct("id", "node")).alias("text"))

    def folded(batches):
        for b in batches:
            yield table_of(text=pa.array([fold(t) for t in b.column("text").to_pylist()], pa.string()), y=b.column("y"))

    known = kept.mapInArrow(folded, "text string, y int").checkpoint()
    total = {r.y: r for r in known.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    na, nb = (total[y].n if y in total else 0 for y in (1, 0))
    if not na or not nb:
        share = na / (na + nb) if na + nb else 0.0
        return Lexicon({}, (float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0, 0.0), exceptions)

    known = known.coalesce(math.ceil(sum(r["size"] for r in total.values()) / TASK_BYTES))

    # one row an id before the join, so a repeated id is no hot key
    every = docs.groupBy(i.alias("id")).agg(F.count("*").alias("n")).join(marked, "id").groupBy("y").agg(F.sum("n").alias("n"))
    of_class = {r.y: r.n for r in every.collect()}

    def count(batches):
        for b in batches:
            held = (Counter(), Counter())
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                held[y].update(terms_of(text))
            every = list(held[0].keys() | held[1].keys())
            yield table_of(term=pa.array(every, pa.string()), a=np.array([held[1][t] for t in every], dtype=np.int64), b=np.array([held[0][t] for t in every], dtype=np.int64))

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    ea, eb = (a + b) * na / (na + nb), (a + b) * nb / (na + nb)
    g = 2 * (part(a, ea) + part(b, eb) + part(na - a, na - ea) + part(nb - b, nb - eb))
    found = (
        known.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .select("term", "a", "b", g.alias("g")).where((F.col("g") >= LEAST_G) & (a / na > 3 * b / nb)).orderBy(F.desc("g"), "term").limit(terms).collect()
    )
    weights = {r.term: float(min(MOST_WEIGHT, np.log((r.a + 0.5) / (na + 1) * (nb + 1) / (r.b + 0.5)))) for r in found}
    lexicon = Lexicon(weights, (0.0, 0.0, 0.0), exceptions)

    def features(batches):
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column("text").to_pylist()]).reshape(-1, 2)
            yield table_of(u=np.ascontiguousarray(x[:, 0]), v=np.ascontiguousarray(x[:, 1]), y=b.column("y"))

    rows = known.mapInArrow(features, "u double, v double, y int").collect()  # within the sample's bounds
    lexicon.curve = fit_curve(np.array([(r.u, r.v) for r in rows]), np.array([r.y for r in rows], dtype=float), toxic_share=of_class[1] / (of_class[0] + of_class[1]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The columns of `docs` (any names) in a struct `row` and ``score`` (0 to 1) of the whole
    text.  NULL counts as empty; an empty text scores as one without hits.  An empty table
    gives no rows."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                p = b.slice(lo, 1024)
                yield table_of(row=p.column("row"), score=np.array([lexicon.score(t) for t in p.column("text").to_pylist()], dtype=float))

    return rows.mapInArrow(run, f"row {kind}, score double")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(3)) == 1


THRESHOLD = 0.7


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for `documents`; learns from rows that aren't held out."""
    lexicon = learn(docs, labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), lexicon)
    return scored.select("row.doc_id", "row.held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents that score `threshold` or more; all other rows unchanged."""
    lexicon = learn(docs, labels.where(~held_out()))
    return score(docs, lexicon).where(F.col("score") < threshold).select("row.*")
