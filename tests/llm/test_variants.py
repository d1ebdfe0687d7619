import collections
import random
import re
import zlib

import pytest

from tessera.llm import variants

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(docs, least=5, least_count=3):
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least_count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def brute(vocab):
    out, form = [], {}
    pairs = {a: [b for b in vocab if near(a, b)] for a in vocab}
    for a, others in pairs.items():
        best = min(others, key=lambda b: (-vocab[b], b), default=None)
        form[a] = best if best is not None and vocab[best] >= 2 * vocab[a] else None
    for a, others in pairs.items():
        root = a
        while form[root] is not None:
            root = form[root]
        out.append((a, form[a], root, vocab[a], len(others), vocab[form[a]] if form[a] else None))
    return sorted(out, key=repr)


def some(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcéÿ", k=rnd.randrange(4, 9))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "x" * 40, "x" * 41, "x" * 39 + "y"]
    docs = []
    for i in range(60):
        out = []
        for w in rnd.choices(base, [1 / (j + 1) for j in range(len(base))], k=120):
            if rnd.random() < 0.3:
                p, c = rnd.randrange(len(w)), rnd.choice("abcé")
                w = rnd.choice([w[:p] + c + w[p:], w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :]])
            out.append(w.upper() if rnd.random() < 0.1 else w)
        docs.append((i, rnd.choice([" ", ", ", "1", "Ā", "_"]).join(out)))
    docs += [(70, None), (71, ""), (None, docs[1][1]), (2, docs[2][1]), (2, docs[9][1])]
    return docs


@pytest.mark.parametrize(("seed", "rows"), [(1, 60_000), (2, 40)])
def test_against_brute_force(spark, seed, rows):
    """Also with many shards, where frequent halves are spread over several."""
    docs = some(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = variants.spelling_variants(d, shard_rows=rows).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(words_of(docs))


def test_lost_letters(spark):
    """Runs that the checksum picks lose their letter, long and short ones."""
    docs = [(i, "hundred words Abcdef Éléphant " + "z" * 3000) for i in range(600)]
    got = variants.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"))
    want = words_of(docs)
    assert {r.word: r.n for r in got.collect()} == want and len(want) >= 6


def test_near_words(spark):
    """Pairs once each, words of one and two letters included."""
    words = ["a", "b", "ab", "ba", "aba", "abc", "abcd", "bcd", "xbcd", "abxd", "é", "éa", "zzzz"]
    got = variants.near_words(spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").coalesce(1), shard_rows=7).collect()
    pairs = [(r.word, x.word) for r in got for x in r.near]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if near(a, b)}


def test_roots(spark):
    links = [(f"w{i:02}", f"w{i + 1:02}") for i in range(20)] + [("a", "w03"), ("b", "w20")]
    got = variants.roots(spark.createDataFrame(links, "word string, form string"))
    assert {r.word: r.root for r in got.collect()} == {w: "w20" for w, _ in links}


def test_odd_tables(spark, odd, none):
    assert variants.digest(none).count() == 0
    assert variants.digest(odd).count() == 0
