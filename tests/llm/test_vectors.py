import numpy as np
import pytest

from tessera.llm import ann, vec_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int, id string, cell int"


def planted(seed=0, n=1500, d=64):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for i in range(0, n, 5):  # near copies around the threshold, and copies
        c = r.uniform(0.90, 0.99)
        z = r.normal(size=d)
        u = x[i] / np.linalg.norm(x[i])
        z -= z @ u * u
        x[i + 1] = c * u + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
        x[i + 2] = x[i] if i % 2 else x[i + 2]
    return x.astype(np.float32), r.integers(0, 3, n)


@pytest.fixture(scope="module")
def vectors(spark):
    x, y = planted()
    rows = [(i, x[i].tolist(), int(y[i // 5]), "r", 1, "i", 2) for i in range(len(x))]
    bad = [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] + [1.0] * 63, 1), (9003, [None] + [1.0] * 63, 1), (9004, [], 1), (9005, x[0].tolist(), None), (9006, [1.0, 2.0], 1), (None, x[0].tolist(), 1), (9100, [float("inf")] * 64, 1)]
    return spark.createDataFrame([*rows, *((*b, None, None, None, None) for b in bad)], SCHEMA).repartition(3).cache()


def test_near_vectors_as_brute_force(vectors):
    x, y = planted()
    x = x.astype(float)
    lab = np.array([y[i // 5] for i in range(len(x))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    link = (s >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    while True:
        low = np.array([min(comp[i], comp[link[i]].min(initial=comp[i])) for i in range(len(x))])
        if (low == comp).all():
            break
        comp = low
    got = {r.vec_id: r for r in vec_dedup.digest(vectors).collect() if r.vec_id is not None}
    links = sum(got[i].n_links for i in range(len(x)))
    assert links >= 0.999 * link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    assert sum(got[i].component_id != comp[i] for i in range(len(x))) <= 2
    for i in (9000, 9001, 9002, 9003, 9004, 9005, 9006, 9100):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_large_bucket_in_blocks(spark, monkeypatch):
    """Many near copies of one vector: links are counted, not listed, over several blocks."""
    monkeypatch.setattr(vec_dedup, "BLOCK", 16)
    r = np.random.default_rng(2)
    base = r.normal(size=16)
    x = [base + 0.01 * r.normal(size=16) for _ in range(90)] + [base] * 30
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = vec_dedup.digest(df).collect()
    assert {(q.n_links, q.component_id) for q in got} == {(119, 0)}


def test_nearest_recall_and_scores(vectors):
    x, _ = planted()
    x = x.astype(float)
    got: dict[int, list] = {}
    for q in ann.digest(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append(q)
    hit = 0
    queries = range(0, 1500, 100)
    other = [*range(1500), 9005]
    y = np.vstack([x, x[:1]])
    for q in queries:
        d = np.sqrt(((y - x[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((other, d))[:10]
        near = got[q]
        assert [r.rank for r in near] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in near] == sorted((r.score, r.vec_id) for r in near)
        assert all(r.vec_id != q and abs(r.score - np.sqrt(((y[other.index(r.vec_id)] - x[q]) ** 2).sum())) < 1e-12 for r in near)
        hit += len({other[i] for i in order} & {r.vec_id for r in near})
    assert hit >= 0.9 * 10 * len(queries)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.digest(df).orderBy("rank").collect()]
    assert got == [(100, 1, 2), (100, 2, 3)]
    assert ann.digest(df.where("false")).count() == 0
    assert vec_dedup.digest(df.selectExpr("*", "1 as label").where("false")).count() == 0
    with_ties = spark.createDataFrame([(0, [0.0, 1.0])] + [(i, [1.0, 0.0]) for i in range(1, 30)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.digest(with_ties).orderBy("rank").collect()] == list(range(1, 11))


@pytest.mark.parametrize("norm", [1, 20, 100])
def test_copies_and_norms(norm):
    """Exact copies, and all else, are found whatever the norm: a block's scan against brute force."""
    r = np.random.default_rng(norm)
    x = r.normal(size=(1500, 64))
    x = norm * x / np.linalg.norm(x, axis=1)[:, None]
    x[200:600] = x[r.integers(0, 12, 400)]
    x = x.astype(np.float32).astype(float)
    turn = ann.rotation(64)
    columns = np.concatenate([(x @ turn).astype(np.float32)[:, s : s + ann.COLUMNS].ravel() for s in range(0, 64, ann.COLUMNS)])
    asked = np.arange(0, 1500, 10)
    q, i, dist = ann.scan(x[asked], asked, x, np.arange(1500), columns, turn, 10)
    hit = 0
    for a in asked:
        d = np.sqrt(((x - x[a]) ** 2).sum(1))
        d[a] = np.inf
        order = np.lexsort((np.arange(1500), d))[:10]
        hit += len(set(order) & set(i[q == a]))
        if d[order[9]] == 0:
            assert list(i[q == a]) == list(order)
    assert hit >= 0.97 * 10 * len(asked)


@pytest.mark.parametrize("norm", [1, 20, 100])
def test_recall_over_many_vectors(spark, norm):
    """30,000 vectors, a third of them copies and near copies."""
    r = np.random.default_rng(7)
    x = r.normal(size=(30_000, 32))
    x[20_000:] = x[r.integers(0, 500, 10_000)] + 0.02 * r.integers(0, 2, (10_000, 1)) * r.normal(size=(10_000, 32))
    x = (norm * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<float>").repartition(8)
    got: dict[int, set] = {}
    for row in ann.digest(df).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    x = x.astype(float)
    hit = 0
    for a in range(0, 30_000, 100):
        d = ((x - x[a]) ** 2).sum(1)
        d[a] = np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), d))[:10].tolist()) & got[a])
    assert hit >= 0.9 * 10 * 300
