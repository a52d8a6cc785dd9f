"""Corpus pipeline: five stages from ``documents`` to token files, each of which calls one operator of ``segrank.llm``.

Each stage reads what its predecessor kept, written as Parquet; all but the last return the columns of ``documents``.
The last one writes the token files and returns their index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segrank.llm import decontaminate, mixing, ngram_join, token_orc, toxicity
from segrank.llm.common import read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows that are not held out."""
    model = toxicity.train(toxicity.training_rows(docs, read_table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the first document stays."""
    return ngram_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), mode="drop")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files: doc_id, start, n_tokens, ids_crc32; a repeated document has a row each time."""
    return token_orc.tokenize(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

# Toxicity, mixing and tokens can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
