"""Passage-vector -> document-vector aggregation.

Input ``impacts(doc_id, psg, n_psg, term, w)``: ``n_psg`` (passages in the
document) is carried on every row from the nested passage form, so the
aggregations that divide by the number of passages used need no join.
Passage ids are dense 0..n_psg-1 (``split_passages`` / ``reindex_passages``),
so "first n passages" is the pushed-down filter ``psg < n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrank.functions.numeric import GMEAN_EPS

MODES = ("first", "max", "sum", "mean", "exp", "gmean")


def aggregate_passages(impacts: DataFrame, mode: str, n: int | None = 1) -> DataFrame:
    """``doc_impacts(doc_id, term, w DOUBLE)`` from the first ``n``
    passages of every document (``None``: all of them)."""
    n = 2**31 - 1 if n is None else n
    if mode not in MODES:
        raise ValueError(f"{mode!r} is none of the aggregations {sorted(MODES)}")
    if mode == "first":  # A1: the first passage, n ignored
        return impacts.filter(F.col("psg") == 0).select(
            "doc_id", "term", F.col("w").cast("double").alias("w"))
    kept = impacts.filter(F.col("psg") < n)
    g = kept.groupBy("doc_id", "term")
    n_used = F.least(F.lit(n), F.first("n_psg"))
    w = F.col("w").cast("double")
    if mode == "max":  # A2 (starts from 0)
        val = F.greatest(F.max(w), F.lit(0.0))
    elif mode == "sum":  # A3
        val = F.sum(w)
    elif mode == "mean":  # A4: absent term counts as 0
        val = F.sum(w) / n_used
    elif mode == "exp":  # A5
        return (g.agg(F.max(w).alias("m"), F.count(F.lit(1)).alias("cnt"),
                      F.first("n_psg").alias("n_psg"), F.collect_list(w).alias("ws"))
                .select("doc_id", "term", F.ceil(
                    F.col("m") + F.log(
                        F.aggregate("ws", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m")))
                        + (F.least(F.lit(n), F.col("n_psg")) - F.col("cnt")) * F.exp(-F.col("m")))
                    - F.log(F.least(F.lit(n), F.col("n_psg")).cast("double"))
                    - F.lit(GMEAN_EPS)).cast("double").alias("w")))
    else:  # A6: over passages containing the term
        val = F.ceil(F.exp(F.avg(F.log(w))) - F.lit(GMEAN_EPS)).cast("double")
    return g.agg(val.cast("double").alias("w"))


def aggregate_sweep(impacts: DataFrame, max_n: int = 10, modes=("max", "mean", "sum")) -> DataFrame:
    """Every n in 1..max_n and every mode in one pass: an entry is exchanged once, the maxima and sums of all n are columns of
    one aggregate on ``(doc_id, term)``, and only its rows are multiplied.  Returns ``(mode, n, doc_id, term, w)``."""
    ns = range(1, max_n + 1)
    kept = impacts.filter(F.col("psg") < max_n).select("doc_id", "term", "n_psg", "psg", F.col("w").cast("double").alias("w"))
    first = lambda n: F.when(F.col("psg") < n, F.col("w"))
    agg = kept.groupBy("doc_id", "term").agg(
        F.first("n_psg").alias("n_psg"), *[F.max(first(n)).alias(f"mx{n}") for n in ns], *[F.sum(first(n)).alias(f"sm{n}") for n in ns])
    value = lambda m, n: {"max": F.greatest(F.col(f"mx{n}"), F.lit(0.0)), "sum": F.col(f"sm{n}"),
                          "mean": F.col(f"sm{n}") / F.least(F.lit(n), F.col("n_psg"))}[m]
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(n).alias("n"), value(m, n).alias("w"), F.col(f"sm{n}").isNotNull().alias("there"))
                     for n in ns for m in modes])
    return (agg.select("doc_id", "term", F.explode(rows).alias("x")).where("x.there")
            .select("x.mode", "x.n", "doc_id", "term", "x.w"))
