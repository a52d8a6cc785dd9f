"""Streaming passage splitting and impact encoding for new documents.

``documents`` files landing in a folder are split into passages (T2-T5)
and encoded with a static term-weight table (stream-static join, E2/E3 +
E10); each micro-batch is a partition of Parquet tables.  Progress lives in
a checkpoint under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrank.functions.numeric import quantise
from segrank.functions.text import tokens as tokens_of
from segrank.operators import segment
from segrank.session import ensure_checkpoint_dir

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def passage_stream(spark: SparkSession, src_dir: str, budget: int = segment.DEFAULT_BUDGET,
                   max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming ``(doc_id, psg, text, n_tok, n_psg)`` from Parquet document files."""
    docs = (spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(src_dir)
            .select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    return (segment.doc_passages(docs, budget).select("doc_id", F.inline_outer("psgs"))
            .filter(F.col("psg").isNotNull()))


def encode_batch(passages: DataFrame, term_weights: DataFrame) -> DataFrame:
    """tf-idf impacts of one micro-batch of passages (static weights)."""
    toks = (passages.select("doc_id", "psg", F.explode_outer(tokens_of(F.col("text"))).alias("term"))
            .filter(F.col("term").isNotNull()))
    tf = toks.groupBy("doc_id", "psg", "term").agg(F.count(F.lit(1)).alias("tf"))
    return (tf.join(term_weights, "term")
            .select("doc_id", "psg", "term",
                    quantise(F.col("scale") * (F.lit(1.0) + F.log(F.col("tf").cast("double")))).alias("w"))
            .filter(F.col("w") != 0))


def start_ingest(spark: SparkSession, src_dir: str, out_dir: str, term_weights: DataFrame,
                 budget: int = segment.DEFAULT_BUDGET, available_now: bool = True, name: str = "ingest"):
    """Start the stream; returns the ``StreamingQuery``.  Passages and
    impacts of each micro-batch go to a folder of their own under
    ``out_dir/passages`` and ``out_dir/impacts`` (columns ``stream`` and
    ``batch``), which a repeated batch overwrites: no row is doubled.  Streams
    that share ``out_dir`` need different names."""
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")
    stream = passage_stream(spark, src_dir, budget)

    def sink(batch: DataFrame, batch_id: int) -> None:
        part = os.path.join(f"stream={name}", f"batch={batch_id}")
        batch.write.mode("overwrite").parquet(os.path.join(out_dir, "passages", part))
        encode_batch(batch, term_weights).write.mode("overwrite").parquet(os.path.join(out_dir, "impacts", part))

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
