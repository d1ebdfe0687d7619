import re

from tessera.llm.components import components
from tessera.llm.jaccard import bands_for, digest, jaccard_groups, one_of_each

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_as_brute_force(docs, corpus_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in digest(docs).collect()}
    assert got == brute(corpus_rows, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(docs).select("row.doc_id", "n_shingles", "component_id").collect()}
    assert got == brute(corpus_rows, 5, 80)


def test_blocks_of_large_groups(spark, monkeypatch):
    """A group cut into several blocks, all pairs of blocks compared."""
    from tessera.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(0, 120, 3)]
    rows += [(200 + i, " ".join(base[i:])) for i in range(0, 30, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in digest(df).collect()}
    assert got == brute(rows, 4, 85)


def test_one_stays(docs, corpus_rows):
    out = one_of_each(docs)
    assert out.columns == docs.columns
    want = {i for i, (_, c) in brute(corpus_rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in out.collect()} == want


def test_odd_rows(odd, none):
    out = jaccard_groups(odd).select("row.doc_id", "n_shingles", "component_id").collect()
    assert len(out) == odd.count()
    assert all(r.component_id is None for r in out if r.doc_id is None)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in out if r.doc_id in (3, 4, 9))
    assert {r.component_id for r in out if r.doc_id in (1, 2)} == {1}
    assert jaccard_groups(none).count() == 0
    assert sorted(map(tuple, one_of_each(odd).select("doc_id", "text").collect()), key=repr) == sorted(
        [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 6), (3, None), (4, ""), (None, None), (9, None)], key=repr
    )


def test_one_stays_by_rows(spark):
    """An id with two texts is two documents; repeated rows and copies without an id leave one."""
    t, u, v = (" ".join(f"{x}{i}" for i in range(30)) for x in "tuv")
    rows = [(1, t), (5, t), (5, u), (None, t), (7, u + " end"), (8, v), (8, v), (8, v), (None, "w " * 9), (None, "w " * 9), (9, ""), (9, "")]
    out = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, t), (5, u), (8, v), (None, "w " * 9), (9, ""), (9, "")], key=repr)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 130)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}
    assert components(df.where("false")).count() == 0


def test_small_graph_in_one_task(spark):
    """Rounds over few links leave no files of every shuffle partition."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "37")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    links = own.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long").repartition(5)
    out = components(links)
    assert out.rdd.getNumPartitions() < 37 + 5
    assert {r.node: r.component for r in out.collect()} == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


def test_bands():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** 4) ** bands_for(percent) <= 1e-8
