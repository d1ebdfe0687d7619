import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.conftest import corpus
from tests.llm.test_texts import toxic_corpus


def test_stages(spark, tmp_path):
    rows, labels = toxic_corpus(300)
    rows += [(10_000 + i, t) for i, t in corpus(2, 30)]
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, t, "en", f"src{rnd.randrange(5)}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, str(tmp_path)).collect(), docs.schema)
        assert at.columns == docs.columns
        counts.append(at.count())
    toxic = {i for i, _, y in labels if y}
    left = {r.doc_id for r in at.collect()}
    clean = {i for i, _, y in labels if not y}
    assert len(left & toxic) <= 0.1 * len(toxic) and len(left & clean) >= 0.98 * len(clean)
    assert counts[0] > counts[1] == counts[2]
    out = corpus_pipeline.run(spark, str(tmp_path))
    total = out.groupBy("doc_id").agg(F.sum("length").alias("n"))
    want = at.select("doc_id", F.octet_length("text").cast("long").alias("n"))
    assert total.exceptAll(want).count() == 0 and want.exceptAll(total).count() == 0


def test_run_needs_nothing_of_the_driver_folder(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]


def test_odd_tables(spark, tmp_path, odd):
    """NULLs, repeated ids and rows, blank texts and an empty table go through every stage."""
    labels = "doc_id long, quality int, toxic int"
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, rows, marks in (("odd", docs, [(1, 1, 0), (None, 1, 1), (2, None, None)]), ("empty", docs.limit(0), [])):
        d = str(tmp_path / name)
        rows.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(marks, labels).write.parquet(f"{d}/labels.parquet")
        at = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = spark.createDataFrame(stage(spark, at, d).collect(), docs.schema)
        cleaned = str(tmp_path / f"{name}-cleaned")
        out = corpus_pipeline.run(spark, d, cleaned)
        back = spark.read.parquet(cleaned)
        assert back.columns == docs.columns and sorted(map(repr, back.collect())) == sorted(map(repr, at.collect()))
        assert out.agg(F.sum("length")).first()[0] == back.agg(F.sum(F.octet_length("text"))).first()[0]
        if name == "empty":
            assert out.count() == 0
        else:  # one of the copies, the one with a tail cut to it, and all rows without words
            assert sorted((repr(r.doc_id) for r in back.where("length(text) > 10").collect())) == ["1"]
            assert back.where("coalesce(text, '') = ''").count() == 4


def test_scratch_goes_with_a_place_for_the_texts(spark, tmp_path):
    from tessera.session import checkpoint_dir

    rows = [(i, f"{i} " + "word " * 30, "en", "s", 9) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    import glob

    left = lambda: set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file://')}/tessera-scratch/pipeline-*"))
    before = left()
    assert corpus_pipeline.run(spark, str(tmp_path), str(tmp_path / "cleaned")).count() > 0 and left() == before
    corpus_pipeline.run(spark, str(tmp_path))
    assert len(left() - before) == 1
