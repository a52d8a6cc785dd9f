"""Loaders for the driver tables under ``<sf_dir>/<name>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` as the scan deals it, or dealt to ``spark.segrank.readPartitions`` tasks where a session sets that: a file of one row group
    is otherwise read by one task.  Left unset on a cluster, where the files have enough row groups."""
    n = df.sparkSession.conf.get("spark.segrank.readPartitions", None)
    return df.repartition(int(n)) if n else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus(doc_id STRING, text STRING)`` from ``documents``."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return spread(docs)
