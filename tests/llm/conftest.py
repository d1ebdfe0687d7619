import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, dk long, score string, packed string, ids int, shard string"


def words(rnd, n, vocabulary=4000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, and the odd cases."""
    rnd = random.Random(seed)
    passage = words(rnd, 60)
    base = [words(rnd, rnd.randrange(5, 200)) for _ in range(n)]
    texts = list(base)
    for i in range(0, n, 4):
        t = base[i].split(" ")
        if len(t) > 30:
            t[len(t) // 2] = "changed"
        texts.append(" ".join(t))
    texts += [base[0]] * 3 + [f"{words(rnd, 20)} {passage}\t{words(rnd, 15)}" for _ in range(5)]
    texts += ["", " \n\t ", "one", "A b c", "x" * 5000, "ab " * 400, "ÄÖ é 漢字 " * 30, words(rnd, 20) + " " + words(rnd, 3) * 40, "Mixed CASE words " * 3 + base[1], passage]
    return [(i, t) for i, t in enumerate(texts)]


def as_rows(pairs):
    return [(i, t, "en", f"src{(i or 0) % 3}" if i is not None else None, None, "r", 7, "s", "p", 1, None) for i, t in pairs]


@pytest.fixture(scope="session")
def corpus_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, corpus_rows):
    """Extra columns have the names that the operators use themselves."""
    return spark.createDataFrame(as_rows(corpus_rows), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """NULL in every column, repeated rows, one id with two texts."""
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 6
    rows = as_rows([(1, t), (1, t), (2, t), (2, t + " tail"), (3, None), (4, ""), (None, t), (None, None)])
    return spark.createDataFrame([*rows, (9, None, *[None] * 9)], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
