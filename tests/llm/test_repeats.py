import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hashing, repeats
from tessera.llm.substring_dedup import substring_dedup, without_repeats
from tessera.llm.suffix_dedup import suffix_dedup


def brute(rows, split, length, join):
    first, out = set(), {}
    for i, t in sorted(rows):
        s = split(t)
        gone = [False] * len(s)
        for p in range(len(s) - length + 1):
            w = tuple(s[p : p + length])
            if w in first:
                gone[p : p + length] = [True] * length
            first.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(s), sum(gone), spans, join([x for x, g in zip(s, gone, strict=True) if not g]))
    return out


def in_bytes(t):
    return (t or "").encode()


def in_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def spread(df, n):
    return df.select("row.doc_id", n, "n_removed", F.size("spans").alias("s"), "kept")


@pytest.mark.parametrize("together", [1000, 1])
def test_bytes_as_brute_force(docs, corpus_rows, together):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.s, bytes(r.kept)) for r in spread(suffix_dedup(docs, together=together), "n_bytes").collect()}
    assert got == brute(corpus_rows, in_bytes, 100, bytes)


@pytest.mark.parametrize("together", [1000, 1])
def test_words_as_brute_force(docs, corpus_rows, together):
    got = {r.doc_id: (r.n_words, r.n_removed, r.s, r.kept) for r in spread(substring_dedup(docs, together=together), "n_words").collect()}
    assert got == brute(corpus_rows, in_words, 20, " ".join)


def test_long_text_in_pieces(spark, monkeypatch):
    """A text of several pieces, with repeats across their borders."""
    import random

    rnd = random.Random(3)
    part = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(90_000))
    text = part + " middle " + part[1000:]
    rows = [(0, text), (1, part[600_000:620_000])]
    assert len(part) > hashing.PIECE // 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup(df).select("row.doc_id", "n_removed", "kept").collect()}
    kept = text[: text.rindex(part[1000:1100])].encode()
    # what precedes the second copy may match a few bytes further
    assert got[1][0] == 20_000
    assert 0 <= got[0][0] - (len(part) - 1000) <= 1 and got[0][1] in {hashlib.sha256(kept[: len(kept) - k]).hexdigest() for k in (0, 1)}


def test_odd_rows(odd, none):
    for op, n in ((suffix_dedup, "n_bytes"), (substring_dedup, "n_words")):
        out = op(odd).select("row.*", n, "n_removed").collect()
        assert len(out) == odd.count()
        one = [r for r in out if r.doc_id == 1]
        assert len(one) == 2 and one[0] == one[1]  # equal rows are one document
        assert all(r[n] == 0 and r.n_removed == 0 for r in out if r.doc_id in (3, 4, 9))
        assert op(none).count() == 0


def test_columns_stay(docs):
    out = without_repeats(docs)
    assert out.columns == docs.columns
    same = out.join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").where("n_chars <> length(text) or (text <> before and length(text) >= length(before))")
    assert same.count() == 0


def test_same_result_by_partitions(docs):
    want = None
    for n in (1, 5):
        got = sorted(spread(substring_dedup(docs.repartition(n)), "n_words").collect())
        want = want or got
        assert got == want


def test_slice_hashes():
    r = hashing.Roller(12345)
    x = np.random.Generator(np.random.PCG64(1)).integers(0, 2**63, 9000, dtype=np.uint64)
    x[5000:5100] = x[200:300]
    s = r.sums(x)
    assert r.slices(s, np.array([200]), np.array([300])) == r.slices(s, np.array([5000]), np.array([5100]))
    assert (hashing.sliding_min(x, 7) == np.lib.stride_tricks.sliding_window_view(x, 7).min(1)).all()


def test_runs_of_one_value():
    """Ties in the choice of an anchor: every window is in exactly one phrase."""
    codes = np.full(500, 77, dtype=np.uint64)
    row, start, count, _, _ = repeats.phrases(codes, np.array([0, 300, 500]), 100, 20)
    places = [(r, p) for r, s, c in zip(row, start, count, strict=True) for p in range(s, s + c)]
    assert sorted(places) == [(0, p) for p in range(201)] + [(1, p) for p in range(101)]


def test_many_rows_share_an_id(spark):
    """Ten thousand rows without an id, and thousands with the same one, are as many documents.  They come in the order
    of their keys, which the brute force takes over."""
    import random

    rnd = random.Random(8)
    passages = [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(rnd.randrange(20, 60))) for _ in range(40)]
    rows = [(None if k < 10_000 else 5, f"{'x' * rnd.randrange(40)} {k} " + rnd.choice(passages) + f" {rnd.randrange(10**6)}") for k in range(13_000)]
    rows += [(3, passages[0]), (7, passages[1] + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = repeats.keyed(df, "doc_id", "text").select("dk", "tie", "rest.doc_id").collect()
    assert len({(r.dk, r.tie) for r in order}) == len(rows)
    key = df.select("text", F.coalesce("doc_id", F.lit(0)).alias("dk"), F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long")).alias("tie")).collect()
    ordered = [((r.dk, r.tie), r.text) for r in key]
    name = {t: k for k, t in ordered}
    for op, n, split, length, join in ((suffix_dedup, "n_bytes", in_bytes, 100, bytes), (substring_dedup, "n_words", in_words, 20, " ".join)):
        want = brute(ordered, split, length, join)
        got = op(df.withColumn("again", F.col("text"))).select("row.again", n, "n_removed", F.size("spans").alias("s"), "kept").collect()
        assert {name[r.again]: (r[n], r.n_removed, r.s, bytes(r.kept) if join is bytes else r.kept) for r in got} == want


def test_suffix_ranks_as_sorted_suffixes():
    """Ranks by the first bytes are the order of the suffixes, cut to that depth."""
    from tessera.llm.suffix_dedup import suffix_ranks

    r = np.random.default_rng(3)
    for n, depth in ((1, 8), (5, 100), (300, 5), (300, 8), (400, 13), (500, 100)):
        text = r.integers(97, 99, n).astype(np.uint8)
        text[n // 2 :] = text[: n - n // 2]
        raw = text.tobytes()
        cut = [raw[p : p + depth] + b"\0" * (depth - len(raw[p : p + depth])) for p in range(n)]
        rank = suffix_ranks(text, depth)
        assert [cut[i] for i in np.argsort(rank, kind="stable")] == sorted(cut)
        assert len(set(rank.tolist())) == len(set(cut))


def test_classes_are_equal_windows():
    """By suffix order and by extension, two windows share a class only if they are equal, and always if their phrases
    share the anchor."""
    from tessera.llm.substring_dedup import SEED_WORDS, by_extension
    from tessera.llm.suffix_dedup import TRIGGER, by_suffixes

    r = np.random.default_rng(9)
    for kind, length, k, make, codes in (
        (np.uint8, 100, TRIGGER, by_suffixes(100), lambda x: hashing.byte_table(20251)[x]),
        (np.uint64, 20, SEED_WORDS, by_extension(20, SEED_WORDS), lambda x: x),
    ):
        base = [hashing.mix(r.integers(1, 60, 400).astype(np.uint64)) if kind is np.uint64 else r.integers(97, 123, 900).astype(np.uint8) for _ in range(4)]
        rows = [np.concatenate([base[a][p : p + 3 * length], base[b][q : q + 2 * length]]) for a, b, p, q in r.integers(0, 4, (60, 4)) * [1, 1, 25, 31]]
        rows.append(np.full(3 * length, rows[0][0], dtype=kind))
        items, off = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        row, start, count, anchor, _ = repeats.phrases(codes(items), off, length, k)
        order = np.argsort(anchor, kind="stable")
        row, start, count, anchor = row[order], start[order] + off[row[order]], count[order], anchor[order]
        size = count + length - 1
        body = items[repeats.ranges(start, size)]
        got = make(body, np.concatenate([[0], np.cumsum(size)]), count, anchor)
        windows = [tuple(items[s + j : s + j + length].tolist()) for s, c in zip(start, count, strict=True) for j in range(c)]
        by = {}
        for c, w in zip(got.tolist(), windows, strict=True):
            by.setdefault(c, set()).add(w)
        assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(windows))
