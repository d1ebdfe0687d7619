import hashlib
import random
import re

import pytest

from tessera.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + m]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w = words_of(text)
        hit, own = set(), set()
        for m in {len(x) for x in windows}:
            for p in range(len(w) - m + 1):
                found = windows.get(tuple(w[p : p + m]))
                if found:
                    own |= found
                    hit |= set(range(p, p + m))
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def some(seed):
    rnd = random.Random(seed)
    text = lambda n, v: " ".join(rnd.choice(["w", "W", "é", "9"]) + str(rnd.randrange(v)) for _ in range(n))
    items = [(i, text(rnd.randrange(1, 60), 500)) for i in range(30)] + [(30, "solo7"), (31, "ab cd"), (32, ""), (33, None), (None, text(12, 9)), (30, text(20, 500)), (34, "a " * 25)]
    docs = []
    for i in range(120):
        t = text(rnd.randrange(0, 80), 500)
        for _ in range(rnd.randrange(0, 3)):
            src = (rnd.choice(items)[1] or "").split(" ")
            a = rnd.randrange(len(src))
            t = t + rnd.choice([" ", "\n", ", "]) + "-".join(src[a : a + rnd.randrange(1, 40)]).upper() + " " + text(3, 50)
        docs.append((i, t))
    docs += [(200, None), (201, ""), (None, docs[3][1]), (5, docs[6][1]), (5, docs[5][1]), (300, "a " * 40 + "AB, cd. solo7"), (301, "é")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = some(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontaminate.digest(d, i).collect()), key=repr) == brute(docs, items)


def test_many_blocks_and_long_texts(spark, monkeypatch):
    """A benchmark in many passes, and a text that is cut into pieces, give the same."""
    docs, items = some(3)
    long_text = " ".join(t for _, t in docs if t) + " " + "x" * 3000 + " " + " ".join(t for _, t in items if t)
    docs.append((400, long_text))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.decontaminate(d, i)
    parts = decontaminate.decontaminate(d, i, block_bytes=300)
    assert len(list(decontaminate.pattern_blocks(i, "item_id", "text", 10, 300))) > 5
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(whole) == key(parts)
    import numpy as np
    import pyarrow as pa

    (names, groups), = decontaminate.pattern_blocks(i, "item_id", "text", 10, 1 << 30)
    text, names = pa.array([long_text, "a b"]), pa.array(names)
    at_once = decontaminate.scan(text, names, groups)
    original = decontaminate.word_pieces
    monkeypatch.setattr(decontaminate, "word_pieces", lambda col, lap: original(col, lap=lap, most=257))
    in_pieces = decontaminate.scan(text, names, groups)
    assert np.array_equal(at_once[0], in_pieces[0]) and at_once[1].equals(in_pieces[1]) and at_once[2].equals(in_pieces[2])


def test_long_items(spark, monkeypatch):
    """An item that comes to the driver in pieces keeps every window."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    docs, items = some(4)
    got = decontaminate.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_odd_tables(spark, odd, docs, none):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, None)], "item_id long, text string")
    empty = items.limit(0)
    out = decontaminate.decontaminate(odd, items)
    assert out.count() == odd.count() and out.where("n_hit > 0").count() == 5
    assert decontaminate.decontaminate(odd, empty).where("n_hit = 0").count() == odd.count()
    assert decontaminate.digest(none, items).count() == 0
    assert set(out.select("row.*").columns) == set(odd.columns) - {"text"}
