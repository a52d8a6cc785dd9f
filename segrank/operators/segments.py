"""Passage-relevance and sparse-representation analysis.

Segments are 1-based passage numbers.  Set algebra over the terms of a
document's segments is done with one bit per segment: ``bit_or`` per
(document, term), then conditional counts per document - one shuffle on
the document, no self-joins between segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segrank.plans.util import small

# fixed values: segment pairs / others of the reference analysis
SHARED_WITH = (2, 3, 4, 6)
OTHERS = ((2,), (2, 3), (2, 3, 4), (2, 3, 4, 6))


def parse_passage_run(psg_run: DataFrame) -> DataFrame:
    """``(qid, doc_id, segment, rank, score)``, segment = psg + 1."""
    return psg_run.select("qid", "doc_id", (F.col("psg") + 1).alias("segment"), "rank", "score")


def best_segments(seg_run: DataFrame) -> DataFrame:
    """Best and second-best segment per (query, document) over the whole
    run (no chunking); ties: lower segment first; difference NULL when the
    document has a single retrieved segment."""
    w = Window.partitionBy("qid", "doc_id").orderBy(F.col("score").desc(), F.col("segment").asc())
    r = seg_run.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    g = r.groupBy("qid", "doc_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("segment"))).alias("max_segment"),
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("max_score"),
        F.max(F.when(F.col("rn") == 2, F.col("segment"))).alias("second_segment"),
        F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second_score"))
    return g.withColumn("diff", F.round(F.col("max_score") - F.col("second_score"), 6))


def judged_only(df: DataFrame, qrels: DataFrame) -> DataFrame:
    """Restrict to judged (query, document) pairs."""
    return df.join(qrels.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")


def best_segment_histogram(best: DataFrame, top: int = 20) -> DataFrame:
    """How often each segment is the best one, top ``top`` by count."""
    c = best.groupBy("max_segment").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc(), F.col("max_segment").asc()).limit(top)


def _bit(seg_col: str) -> Column:
    return F.expr(f"shiftleft(1, CAST({seg_col} AS INT) - 1)")


def segment_masks(seg_vec: DataFrame, keys=("doc_id",), max_seg: int = 6) -> DataFrame:
    """``(keys..., term, mask)``: bit s-1 set when segment s has the term."""
    return (seg_vec.filter(F.col("segment") <= max_seg)
            .groupBy(*keys, "term").agg(F.bit_or(_bit("segment")).alias("mask")))


def term_ratios(seg_vec: DataFrame, doc_segments: DataFrame) -> DataFrame:
    """V1-V3: ``(doc_id, measure, others, ratio)`` for segment 1 against the
    other segments: shared (one other segment), global (in every present
    other) and unique (in no present other).  Absent others are ignored; no
    present other -> NULL; empty segment 1 -> no row (0/0)."""
    masks = segment_masks(seg_vec)
    m = masks.join(doc_segments, "doc_id")   # doc_segments(doc_id, n_seg)
    mask = F.col("mask")
    one = mask.bitwiseAND(1) == 1

    def present(segs):
        return sum((F.when(F.col("n_seg") >= s, F.lit(1 << (s - 1))).otherwise(F.lit(0)) for s in segs), F.lit(0))

    aggs = [F.count(F.when(one, True)).alias("n1"), F.first("n_seg").alias("n_seg")]
    for b in SHARED_WITH:
        aggs.append(F.count(F.when(one & (mask.bitwiseAND(1 << (b - 1)) != 0), True)).alias(f"s_{b}"))
    for o in OTHERS:
        tag = "_".join(map(str, o))
        pm = present(o)
        aggs.append(F.count(F.when(one & (mask.bitwiseAND(pm) == pm), True)).alias(f"g_{tag}"))
        aggs.append(F.count(F.when(one & (mask.bitwiseAND(pm) == 0), True)).alias(f"u_{tag}"))
    per = m.groupBy("doc_id").agg(*aggs).filter(F.col("n1") > 0)
    rows = []
    for b in SHARED_WITH:
        rows.append(F.struct(F.lit("shared").alias("measure"), F.lit(f"1-{b}").alias("others"),
                             F.when(F.col("n_seg") >= b, F.col(f"s_{b}") / F.col("n1")).alias("ratio")))
    for o in OTHERS:
        tag = "_".join(map(str, o))
        anyp = F.col("n_seg") >= min(o)
        label = "1-" + ",".join(map(str, o))
        rows.append(F.struct(F.lit("global").alias("measure"), F.lit(label).alias("others"),
                             F.when(anyp, F.col(f"g_{tag}") / F.col("n1")).alias("ratio")))
        rows.append(F.struct(F.lit("unique").alias("measure"), F.lit(label).alias("others"),
                             F.when(anyp, F.col(f"u_{tag}") / F.col("n1")).alias("ratio")))
    return per.select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")


def ratio_summary(ratios: DataFrame) -> DataFrame:
    """V4: non-null count, mean, sample std per (measure, others)."""
    return ratios.groupBy("measure", "others").agg(
        F.count("ratio").alias("n"), F.round(F.avg("ratio"), 6).alias("mean"),
        F.round(F.stddev_samp("ratio"), 6).alias("std"))


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
RANKS = 100_000      # a quantile's rank is at most n / RANKS off


def ratio_quantiles(ratios: DataFrame, probs=QUANTILES, ranks: int = RANKS) -> DataFrame:
    """V4 (violin shape): ``(measure, others, p, value, n)``, the value at rank ceil(p n).  Each task keeps a sketch of at most
    about ``ranks`` values a group, the sketches are merged, and no group is sorted or collected."""
    g = ratios.groupBy("measure", "others").agg(F.percentile_approx("ratio", list(probs), ranks).alias("q"), F.count("ratio").alias("n"))
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.col("q")[k].alias("value")) for k, p in enumerate(probs)])
    return g.where("n > 0").select("measure", "others", F.inline(rows), "n").select("measure", "others", "p", "value", "n")


def z_normalise(ratios: DataFrame) -> DataFrame:
    """V5: ``(x - mean) / std`` per group, keeping the raw value (Q8).  The
    per-group statistics are one row per group, joined back by broadcast -
    no window holding a whole group."""
    st = ratios.groupBy("measure", "others").agg(F.avg("ratio").alias("mu"), F.stddev_samp("ratio").alias("sd"))
    return ratios.join(F.broadcast(st), ["measure", "others"]).select(
        "doc_id", "measure", "others", "ratio",
        F.when(F.col("sd") > 0, (F.col("ratio") - F.col("mu")) / F.col("sd")).alias("z"))


def first_three_segments(seg_vec: DataFrame, doc_segments: DataFrame, qrels: DataFrame) -> DataFrame:
    """V6: judged documents with more than 2 segments, segments 1..3 only.  The judged documents are counted and broadcast, so the
    entries of the others stay where they are."""
    docs = doc_segments.filter(F.col("n_seg") > 2).select("doc_id") \
        .join(small(qrels.select("doc_id").distinct()), "doc_id", "left_semi")
    return seg_vec.filter(F.col("segment") <= 3).join(small(docs.distinct()), "doc_id", "left_semi")


def with_queries(seg_vec: DataFrame, qrels: DataFrame, query_tf: DataFrame, min_rel: int = 1) -> DataFrame:
    """V7: segment vectors joined with the judging queries and their term
    frequencies: ``(qid, doc_id, segment, term, w, qtf)``."""
    j = qrels.filter(F.col("rel") >= min_rel).select("qid", "doc_id")
    return seg_vec.join(j, "doc_id").join(query_tf, ["qid", "term"]) \
        .select("qid", "doc_id", "segment", "term", "w", "qtf")


def venn_regions(matched: DataFrame) -> DataFrame:
    """V8: per (query, document) the number of matching query terms in each
    of the 7 presence regions of segments 1..3 (mask 1..7)."""
    masks = segment_masks(matched, ("qid", "doc_id"), 3)
    return masks.groupBy("qid", "doc_id", "mask").agg(F.count(F.lit(1)).alias("n_terms"))


def region_shares(matched: DataFrame) -> DataFrame:
    """V9: share (%) of the segment-1 score ``sum w1 * qtf`` carried by terms
    only in segment 1, in segment 1 and exactly one of 2/3, and in all
    three; NULL when the segment-1 score is 0."""
    masks = segment_masks(matched, ("qid", "doc_id"), 3)
    s1 = matched.filter(F.col("segment") == 1).select("qid", "doc_id", "term",
                                                      (F.col("w") * F.col("qtf")).alias("sc"))
    j = s1.join(masks, ["qid", "doc_id", "term"])
    tot = F.sum("sc")
    return j.groupBy("qid", "doc_id").agg(
        tot.alias("score_1st"),
        F.sum(F.when(F.col("mask") == 1, F.col("sc")).otherwise(0)).alias("only_first"),
        F.sum(F.when(F.col("mask").isin(3, 5), F.col("sc")).otherwise(0)).alias("intersection"),
        F.sum(F.when(F.col("mask") == 7, F.col("sc")).otherwise(0)).alias("global_term")) \
        .select("qid", "doc_id", *[F.round(F.when(F.col("score_1st") > 0, F.col(c) * 100.0 / F.col("score_1st")), 6).alias(c)
                                   for c in ("only_first", "intersection", "global_term")])


def influence(shares: DataFrame) -> DataFrame:
    """Each region's sum over all pairs as a % of the three regions' total."""
    s = shares.agg(*[F.sum(c).alias(c) for c in ("only_first", "intersection", "global_term")])
    tot = F.col("only_first") + F.col("intersection") + F.col("global_term")
    return s.select(*[F.round(F.col(c) * 100.0 / tot, 4).alias(c) for c in ("only_first", "intersection", "global_term")])


def presence_regions(seg_vec: DataFrame) -> DataFrame:
    """Per document, number of terms in each presence region of segments
    1..3 (mask 1..7), computed with a proper bitmask."""
    return segment_masks(seg_vec, ("doc_id",), 3).groupBy("doc_id", "mask").agg(F.count(F.lit(1)).alias("n_terms"))


def sample_documents(df: DataFrame, percent: int = 10) -> DataFrame:
    """Deterministic per-document sample of ``percent`` %, from a
    portable hash (md5) so any engine can reproduce the same sample."""
    h = F.conv(F.substring(F.md5(F.col("doc_id")), 1, 8), 16, 10).cast("long")
    return df.filter(F.pmod(h, F.lit(100)) < percent)
