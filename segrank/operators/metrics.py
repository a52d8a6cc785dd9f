"""Ranking metrics and significance (M1-M6).

Runs are re-ranked by ``score desc, doc_id desc`` (trec_eval convention)
before cutting; every query with at least one relevant judgement is in
the denominator, a judged query missing from the run scores 0; gain is
the relevance grade (linear), discount ``log2(rank + 1)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eval_rank(run: DataFrame, group: tuple = ()) -> DataFrame:
    w = Window.partitionBy(*group, "qid").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    return run.select(*group, "qid", "doc_id", "score").withColumn("erank", F.row_number().over(w))


def per_query(run: DataFrame, qrels: DataFrame, k_rr: int = 10, k_ndcg: int = 10,
              k_recall: int = 1000, group: tuple = (), groups: list | None = None) -> DataFrame:
    """M4: ``(group..., qid, rr, ndcg, recall)`` for every judged query (and
    every run id in ``groups``, values of the ``group`` column or tuples of
    several columns: several runs are evaluated in one job)."""
    kmax = max(k_rr, k_ndcg, k_recall)
    group = tuple(group)
    rel = qrels.filter(F.col("rel") > 0).select("qid", "doc_id", "rel")
    judged = rel.select("qid").distinct()
    ranked = eval_rank(run, group).filter(F.col("erank") <= kmax).join(judged, "qid", "left_semi")
    hits = ranked.join(rel, ["qid", "doc_id"])
    got = hits.groupBy(*group, "qid").agg(
        F.min(F.when(F.col("erank") <= k_rr, F.col("erank"))).alias("first_rel"),
        F.sum(F.when(F.col("erank") <= k_ndcg, F.col("rel") / F.log2(F.col("erank") + 1))).alias("dcg"),
        F.count(F.when(F.col("erank") <= k_recall, True)).alias("n_hit"))
    iw = Window.partitionBy("qid").orderBy(F.col("rel").desc())
    ideal = (rel.withColumn("i", F.row_number().over(iw))
             .groupBy("qid").agg(
                 F.sum(F.when(F.col("i") <= k_ndcg, F.col("rel") / F.log2(F.col("i") + 1))).alias("idcg"),
                 F.count(F.lit(1)).alias("n_rel")))
    if group:
        # every judged query once per run id: an explode of the (few) ids
        if groups is None:
            raise ValueError("grouped evaluation takes the list of the group columns' values")
        ids = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(g if isinstance(g, tuple) else (g,), group)]) for g in groups])
        ideal = ideal.select("*", F.inline(ids))
    out = ideal.join(got, [*group, "qid"], "left")
    return out.select(
        *group, "qid",
        F.coalesce(F.lit(1.0) / F.col("first_rel"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.col("n_hit") / F.col("n_rel"), F.lit(0.0)).alias("recall"))


def summary(run: DataFrame, qrels: DataFrame, k_rr: int = 10, k_ndcg: int = 10,
            k_recall: int = 1000, group: tuple = (), groups: list | None = None) -> DataFrame:
    """M1-M3: ``(group..., n_queries, mrr, ndcg, recall)``, rounded to 6 places."""
    pq = per_query(run, qrels, k_rr, k_ndcg, k_recall, group, groups)
    return pq.groupBy(*group).agg(F.count(F.lit(1)).alias("n_queries"),
                  F.round(F.avg("rr"), 6).alias("mrr"),
                  F.round(F.avg("ndcg"), 6).alias("ndcg"),
                  F.round(F.avg("recall"), 6).alias("recall"))


def paired_t(per_query_a: DataFrame, per_query_b: DataFrame, metric: str = "rr") -> DataFrame:
    """M5: paired t statistic of two runs on a per-query metric (queries in
    both runs).  One row ``(n, mean_a, mean_b, mean_diff, sd_diff, t_stat)``;
    ``t_stat`` is NULL when the differences have zero variance."""
    j = per_query_a.select("qid", F.col(metric).alias("a")).join(
        per_query_b.select("qid", F.col(metric).alias("b")), "qid")
    d = F.col("a") - F.col("b")
    agg = j.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
                F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    t = F.when(F.col("sd_diff") > 1e-12, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt(F.col("n"))))
    return agg.select("n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_diff", "sd_diff")],
                      F.round(t, 6).alias("t_stat"))


def t_pvalue_column(t: Column, n: Column) -> Column:
    """Two-sided p-value of a paired t statistic over ``n`` pairs, by the
    finite series of Student's distribution for whole degrees of freedom
    (about n / 2 terms, folded inside the one summary row); NULL for NULL."""
    v = F.greatest(n - 1, F.lit(1)).cast("double")
    theta, c2 = F.atan(F.abs(t) / F.sqrt(v)), v / (v + t * t)
    even = v % 2 == 0
    last = F.when(even, v / 2 - 1).otherwise((v - 3) / 2).cast("int")
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    ratio = lambda k: F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1)) * c2
    total = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("total")),
        lambda acc, k: F.struct((acc["a"] * ratio(k)).alias("a"), (acc["total"] + acc["a"] * ratio(k)).alias("total")),
        lambda acc: acc["total"])
    inside = (F.when(even, F.sin(theta) * total).when(v == 1, theta * (2 / math.pi))
              .otherwise((theta + F.sin(theta) * F.cos(theta) * total) * (2 / math.pi)))
    return F.when(t.isNotNull(), F.greatest(F.lit(1.0) - inside, F.lit(0.0)))


def training_log(history: DataFrame, every: int = 100) -> DataFrame:
    """M6: mean of logged values per step bucket, rounded to 4 places.
    ``history(step, name, value)``."""
    return history.groupBy((F.col("step") / every).cast("int").alias("bucket"), "name") \
        .agg(F.round(F.avg("value"), 4).alias("value"))
