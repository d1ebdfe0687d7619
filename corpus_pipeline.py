"""Cleaning and packing of a corpus, as a chain of stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the `docs` of the next, which cuts the lineage: a lost
executor costs tasks of one stage only.  All stages but the last return the columns of
`documents`.

Odd rows: a NULL text counts as empty; documents without words stay through all stages (a
NULL text comes out of the third as the empty text).  Rows that share an id are judged by
their own texts.  Of copies one row stays, that of the least id (NULL last), also where id
and text are equal.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, packing, substring_dedup, toxicity
from tessera.llm.queries import table
from tessera.session import drop_scratch, scratch_path

#: Learned weights can't be put into SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the lexicon is learned from `labels`."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard 0.8), the first."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of 20 words and more that an earlier place holds."""
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in bins of 8,192 bytes, no two of one source or one text in a bin."""
    return packing.digest(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", cut_repeats), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str, cleaned: str | None = None) -> DataFrame:
    """All stages: the places of the cleaned documents in their bins.

    What lies between the stages goes to the shared folder, and goes from there once the next
    stage is written.  The cleaned documents, which the result reads, are written to
    `cleaned`, a folder that must not be there yet; without one, they stay in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = cleaned if cleaned and name == STAGES[-2][0] else scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_scratch(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
