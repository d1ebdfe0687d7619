import collections
import math
import random
import re

import numpy as np
import pytest

from tessera.llm import ranked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, df = sum(n for *_, n in held), collections.Counter(t for _, c, _ in held for t in c)
    queries = collections.defaultdict(set)
    for i, t in items:
        queries[i] |= set(terms_of(t))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, c, n in held:
            m = 50 + 50 * n * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r + 1, x[2], x[3]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def some(seed, n=400):
    rnd = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choices(vocabulary, [1 / (i + 1) for i in range(300)], k=n))
    docs = [(i, text(rnd.randrange(1, 120))) for i in range(n)]
    docs += [(900 + i, docs[3][1]) for i in range(40)] + [(5, docs[5][1]), (None, docs[3][1]), (None, docs[8][1]), (990, None), (991, ""), (992, " .,"), (993, "T1 t1, É t2")]
    items = [(i, text(rnd.randrange(1, 30))) for i in range(20)] + [(50, docs[3][1]), (51, "absent"), (52, ""), (53, None), (None, "t250 t1"), (50, "t7"), (54, "é T1")]
    return docs, items


@pytest.mark.parametrize(("seed", "k", "block"), [(1, 50, 1 << 20), (2, 3, 1 << 20), (3, 10, 60)])
def test_against_brute_force(spark, monkeypatch, seed, k, block):
    """Also with small index blocks, where thresholds skip, and with queries in many blocks."""
    docs, items = some(seed)
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 37)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = ranked.ranked_search(d, spark.createDataFrame(items, "item_id long, text string"), k=k, block_bytes=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, k)


def test_bounds_skip_and_hold():
    """A pair's bound is never below what a document gets, and mostly below the sum of the maxima."""
    rng = np.random.default_rng(1)
    docs, terms = 200, 12
    block = ranked.Block(np.arange(docs), np.full(docs, 50), np.arange(terms), np.arange(terms + 1) * 30, np.concatenate([np.sort(rng.choice(docs, 30, replace=False)) for _ in range(terms)]), rng.integers(1, 9, 30 * terms))
    block.weigh(rng.integers(1, 9000, terms), docs, docs * 50)
    pairs = np.array([(a, b) for a in range(terms) for b in range(a + 1, terms)])
    bounds = block.pair_bounds(pairs)
    tighter = 0
    for (a, b), bound in zip(pairs, bounds, strict=True):
        total = np.zeros(docs, dtype=np.int64)
        for i in (a, b):
            d, x = block.postings(i)
            total[d] += x
        assert total.max() == bound
        tighter += bound < block.most[a] + block.most[b]
    assert tighter > len(pairs) / 2
    every = ranked.best_of(block, pairs[:6], bounds[:6], 1)
    assert len(ranked.best_of(block, pairs[:6], bounds[:6], int(every[1].max()))[0]) >= 1
    assert len(ranked.best_of(block, pairs[:6], bounds[:6], int(bounds[:6].sum()) + 1)[0]) == 0


def test_odd_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "a z tail"), (2, None)], "item_id long, text string")
    rows = ranked.ranked_search(odd, items).collect()
    assert [r.rank for r in sorted(rows, key=lambda r: r.rank)] == list(range(1, len(rows) + 1)) and all(r.item_id == 1 for r in rows)
    assert ranked.digest(none, items).count() == 0 and ranked.digest(odd, items.limit(0)).count() == 0


def test_long_text(spark):
    text = "rare " + "common " * 400_000 + "rare end"
    got = ranked.digest(spark.createDataFrame([(1, text), (2, "common rare"), (3, "x")], "doc_id long, text string"), spark.createDataFrame([(7, "rare end")], "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute([(1, text), (2, "common rare"), (3, "x")], [(7, "rare end")], 50)


def test_small_splits_and_results_stay_in_few_tasks(spark, monkeypatch):
    """Whatever the numbers of splits and shuffle partitions; each task writes a file of index blocks, or of results."""
    docs, items = some(4)
    held, made = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), []
    index = ranked.index_blocks
    monkeypatch.setattr(ranked, "index_blocks", lambda *a: made.append(index(*a)) or made[-1])
    monkeypatch.setattr(ranked, "TASK_DOCS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(64)
        got = ranked.ranked_search(d, spark.createDataFrame(items, "item_id long, text string"))
        assert [b.rdd.getNumPartitions() for b in made] == [max(math.ceil(len(docs) / 100), spark.sparkContext.defaultParallelism)]
        assert got.rdd.getNumPartitions() == 1
        monkeypatch.setattr(ranked, "TASK_ROWS", 1)
        many = ranked.ranked_search(d, spark.createDataFrame(items, "item_id long, text string"))
        assert many.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r) for r in many.collect()), key=repr) == brute(docs, items, 50)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
