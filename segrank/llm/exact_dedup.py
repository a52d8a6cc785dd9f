"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent; their exact counts and smallest ids are then computed,
and the verified winners (a proven, small number) are broadcast, so that a group holding a third of all rows is
resolved map-side.  All other digests go through an ordinary shuffle, with partial aggregation before it.

Defined cases: a null text counts as empty; an empty table gives an empty result; a null id is an id like any other
that sorts after all others; rows that repeat an id and a text count each, and all of them carry the flag of
their id; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrank.llm.common import stored

COUNTERS = 1023        # Misra-Gries counters in a summary
HEAVY_SHARE = 256      # a digest with at least 1/256 of all rows is heavy


def normalised(text: str = "text"):
    """White space runs as one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def misra_gries(counters: int):
    """Arrow function: batches of ``digest`` to one summary (digest, low) a partition.

    ``low`` is below the true count by at most rows / (counters + 1).  Whole batches are merged: counts are added,
    then the (counters + 1)th largest is taken off all of them.
    """
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            counted = b.column("digest").value_counts()
            for d, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                held[d] = held.get(d, 0) + n
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {d: n - cut for d, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "low"])
    return summary


def heavy_digests(hashed: DataFrame, counters: int = COUNTERS, share: int = HEAVY_SHARE) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that hold at least 1/``share`` of the rows: at most ``share``.

    A digest with rows / share rows keeps at least rows * (1 / share - 1 / (counters + 1)) in the summed summaries,
    and those sums add up to at most all rows, so the candidates are few (342 with the defaults) at every size.
    """
    total = hashed.agg(F.count(F.lit(1)).alias("all_rows")).scalar()
    summed = (hashed.select("digest").mapInArrow(misra_gries(counters), "digest binary, low long")
              .groupBy("digest").agg(F.sum("low").alias("low")))
    candidates = summed.where(F.col("low") >= total * (1 / share - 1 / (counters + 1))).select("digest")
    exact = (hashed.join(F.broadcast(candidates), "digest", "left_semi")
             .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return exact.where(F.col("group_size") * share >= total).select("digest", "keep_id", "group_size")


def exact_groups(docs: DataFrame, counters: int = COUNTERS, share: int = HEAVY_SHARE) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256 (see the module's contract)."""
    hashed = stored(docs.select("doc_id", F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest")), "digests")
    heavy = stored(heavy_digests(hashed, counters, share), "heavy")
    split = hashed.join(F.broadcast(heavy), "digest", "left")
    resolved = split.where(F.col("group_size").isNotNull())
    light = hashed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = light.join(groups, "digest")
    return resolved.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text an earlier document has."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
