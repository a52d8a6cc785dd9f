"""Dataset shaping by document length.

"Short" documents have fewer than ``SHORT_BELOW`` passages; "long" is
everything *not* short (so documents absent from the collection count as
long) and is always an anti join, never an equality on a cohort label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segrank.plans.util import small

# fixed values
SHORT_BELOW = 3
SHARE_THRESHOLD = 0.66


def passages_per_doc(passages: DataFrame) -> DataFrame:
    """``(doc_id, n_psg)`` with ``n_psg = max(psg) + 1``."""
    return passages.groupBy("doc_id").agg((F.max("psg") + 1).cast("int").alias("n_psg"))


def short_docs(doc_lengths: DataFrame, below: int = SHORT_BELOW) -> DataFrame:
    """Documents with fewer than ``below`` passages."""
    return doc_lengths.filter(F.col("n_psg") < below).select("doc_id")


def with_cohort(df: DataFrame, short: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tag rows ``short`` / ``long`` by membership of ``key`` in ``short``."""
    s = short.select(F.col("doc_id").alias(key)).distinct().withColumn("_short", F.lit(True))
    return df.join(s, key, "left").withColumn(
        "cohort", F.when(F.col("_short"), F.lit("short")).otherwise(F.lit("long"))).drop("_short")


def length_distribution(doc_lengths: DataFrame) -> DataFrame:
    """C4: ``(n_psg, n_docs, cum_docs, cum_share)``.  The distribution has one
    row per distinct length (small), so the running sum is a global window
    over that small table only."""
    d = doc_lengths.groupBy("n_psg").agg(F.count(F.lit(1)).alias("n_docs"))
    w = Window.orderBy("n_psg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy()
    return d.select("n_psg", "n_docs", F.sum("n_docs").over(w).alias("cum_docs"),
                    (F.sum("n_docs").over(w) / F.sum("n_docs").over(tot)).alias("cum_share"))


def threshold_report(dist: DataFrame, threshold: float = SHARE_THRESHOLD) -> DataFrame:
    """Lengths whose cumulative share is <= threshold, and the documents
    beyond it (one row)."""
    return dist.agg(
        F.max(F.when(F.col("cum_share") <= threshold, F.col("n_psg"))).alias("max_n_within"),
        F.sum(F.when(F.col("cum_share") <= threshold, F.col("n_docs"))).alias("docs_within"),
        F.sum(F.when(F.col("cum_share") > threshold, F.col("n_docs"))).alias("docs_beyond"))


def first_rows(dist: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` histogram rows by length (a limit is the feature)."""
    return dist.orderBy("n_psg").limit(n)


def split_by_docs(df: DataFrame, short: DataFrame, cohort: str, key: str = "doc_id") -> DataFrame:
    """Rows whose document is short (semi join) or not short (anti join)."""
    s = short.select(F.col("doc_id").alias(key)).distinct()
    return df.join(s, key, "left_semi" if cohort == "short" else "left_anti")


def tag_short(df: DataFrame, short: DataFrame, key: str = "doc_id", name: str = "is_short") -> DataFrame:
    """``df`` with a flag: its document is short.  Everything else, absent documents too, counts as long."""
    s = short.select(F.col("doc_id").alias(key)).distinct().withColumn(name, F.lit(True))
    return df.join(s, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def tag_run(run: DataFrame, qrels: DataFrame, short: DataFrame) -> DataFrame:
    """C10 in one pass: ``run`` with the cohort of each row, null where the query has no judged document in the
    document's cohort."""
    flags = tag_short(qrels, short).groupBy("qid").agg(F.max("is_short").alias("q_short"), F.max(~F.col("is_short")).alias("q_long"))
    t = tag_short(run, short).join(flags, "qid", "left")
    return t.withColumn("cohort", F.when(F.col("is_short") & F.col("q_short"), "short").when(~F.col("is_short") & F.col("q_long"), "long")) \
        .drop("is_short", "q_short", "q_long")


def tag_triplets(triplets: DataFrame, short: DataFrame) -> DataFrame:
    """C12 in one pass: triplets with the cohort of both documents, null where they differ."""
    docs = triplets.select(F.explode(F.array("pos_id", "neg_id")).alias("doc_id")).distinct()      # few beside the triplets
    mine = small(short.join(small(docs), "doc_id", "left_semi").distinct())
    t = tag_short(tag_short(triplets, mine, "pos_id", "p"), mine, "neg_id", "n")
    return t.withColumn("cohort", F.when(F.col("p") & F.col("n"), "short").when(~F.col("p") & ~F.col("n"), "long")).drop("p", "n")


def tagged_report(tagged: DataFrame) -> DataFrame:
    """Sizes, differences and shares of a split (one row), from one pass over rows with their ``cohort``."""
    j = tagged.agg(F.count(F.lit(1)).alias("n_original"), F.count(F.when(F.col("cohort") == "short", 1)).alias("n_short"),
                   F.count(F.when(F.col("cohort") == "long", 1)).alias("n_long"))
    return j.select("n_original", "n_short", (F.col("n_original") - F.col("n_short")).alias("short_diff"),
                    F.round(F.col("n_short") / F.col("n_original"), 6).alias("short_share"),
                    "n_long", (F.col("n_original") - F.col("n_long")).alias("long_diff"),
                    F.round(F.col("n_long") / F.col("n_original"), 6).alias("long_share"))


def clean_triplets(triplets: DataFrame) -> DataFrame:
    """C11: drop triplets whose positive equals the negative."""
    return triplets.filter(F.col("pos_id") != F.col("neg_id"))


def is_member(short: DataFrame, doc_id: str | Column) -> DataFrame:
    """C14: membership test of one document, by its id or a scalar subquery for it (zero or one row)."""
    return short.filter(F.col("doc_id") == doc_id)
