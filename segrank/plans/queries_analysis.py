"""Registered queries: cohorts (C*), passage relevance (P*) and segment
term analysis (V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from segrank.operators import cohorts as C
from segrank.operators import segments as S
from segrank.plans import oracle as O
from segrank.plans.catalog import register
from segrank.plans.derived import Tables
from segrank.plans.queries_rerank import TRIPLETS, _triplets
from segrank.plans.queries_retrieval import BM25, PSG_RUN, bm25_run, psg_run

COH = ["doc_len AS (SELECT doc_id, CAST(max(psg) + 1 AS INTEGER) AS n_psg FROM passages GROUP BY doc_id)",
       "short AS (SELECT doc_id FROM doc_len WHERE n_psg < 3)",
       "q_short AS (SELECT * FROM qrels WHERE doc_id IN (SELECT doc_id FROM short))",
       "q_long AS (SELECT * FROM qrels WHERE doc_id NOT IN (SELECT doc_id FROM short))"]
DIST = ["""dist AS (SELECT n_psg, n_docs, CAST(sum(n_docs) OVER (ORDER BY n_psg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_docs,
  sum(n_docs) OVER (ORDER BY n_psg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n_docs) OVER () AS cum_share
  FROM (SELECT n_psg, count(*) AS n_docs FROM doc_len GROUP BY n_psg))"""]


def _short(t: Tables):
    return C.short_docs(t.doc_lengths)


@register("c1_doc_lengths", O.with_base(*COH, final="""
SELECT doc_id, n_psg, CASE WHEN n_psg < 3 THEN 'short' ELSE 'long' END AS cohort FROM doc_len"""))
def c1_doc_lengths(t: Tables):
    """C1 + C2: passages per document and its cohort."""
    dl = C.passages_per_doc(t.passages)
    return C.with_cohort(dl, C.short_docs(dl))


@register("c3_route", O.with_base(*COH, final="""
SELECT doc_id, psg, CASE WHEN doc_id IN (SELECT doc_id FROM short) THEN 'short' ELSE 'long' END AS cohort FROM passages"""))
def c3_route(t: Tables):
    """Every passage routed to the short or the long collection."""
    return C.with_cohort(t.passages.select("doc_id", "psg"), _short(t))


@register("c4_distribution", O.with_base(*COH, *DIST, final="""
SELECT n_psg, n_docs, cum_docs, round(cum_share, 6) AS cum_share FROM dist"""))
def c4_distribution(t: Tables):
    """C4: documents per passage count with cumulative count and share."""
    d = C.length_distribution(t.doc_lengths)
    return d.withColumn("cum_share", F.round("cum_share", 6))


@register("c5_threshold", O.with_base(*COH, *DIST, final="""
SELECT max(CASE WHEN cum_share <= 0.66 THEN n_psg END) AS max_n_within,
       CAST(sum(CASE WHEN cum_share <= 0.66 THEN n_docs END) AS BIGINT) AS docs_within,
       CAST(sum(CASE WHEN cum_share > 0.66 THEN n_docs END) AS BIGINT) AS docs_beyond FROM dist"""))
def c5_threshold(t: Tables):
    """Lengths covering up to 66% of the documents, and the remainder."""
    return C.threshold_report(C.length_distribution(t.doc_lengths))


@register("c6_top20", O.with_base(*COH, *DIST, final="""
SELECT n_psg, n_docs, cum_docs, round(cum_share, 6) AS cum_share FROM dist ORDER BY n_psg LIMIT 20"""))
def c6_top20(t: Tables):
    """The first 20 rows of the length histogram."""
    d = C.first_rows(C.length_distribution(t.doc_lengths), 20)
    return d.withColumn("cum_share", F.round("cum_share", 6))


@register("c7_qrels_short", O.with_base(*COH, final="SELECT qid, doc_id, rel FROM q_short"))
def c7_qrels_short(t: Tables):
    """Judgements of short documents."""
    return C.split_by_docs(t.qrels, _short(t), "short")


@register("c7_qrels_long", O.with_base(*COH, final="SELECT qid, doc_id, rel FROM q_long"))
def c7_qrels_long(t: Tables):
    """Judgements of documents that are not short (anti join)."""
    return C.split_by_docs(t.qrels, _short(t), "long")


_REPORT = """SELECT o.n AS n_original, s.n AS n_short, o.n - s.n AS short_diff, round(CAST(s.n AS DOUBLE) / o.n, 6) AS short_share,
  l.n AS n_long, o.n - l.n AS long_diff, round(CAST(l.n AS DOUBLE) / o.n, 6) AS long_share
FROM (SELECT count(*) AS n FROM {o}) o, (SELECT count(*) AS n FROM {s}) s, (SELECT count(*) AS n FROM {l}) l"""


@register("c8_qrels_report", O.with_base(*COH, final=_REPORT.format(o="qrels", s="q_short", l="q_long")))
def c8_qrels_report(t: Tables):
    """Sizes, differences and shares of the judgement split."""
    return C.tagged_report(C.tag_short(t.qrels, _short(t)).withColumn("cohort", F.when(F.col("is_short"), "short").otherwise("long")))


@register("c9_query_split", O.with_base(*COH, final="""
SELECT DISTINCT qid, 'short' AS cohort FROM q_short UNION ALL SELECT DISTINCT qid, 'long' FROM q_long"""))
def c9_query_split(t: Tables):
    """Queries with a judged document in each cohort (may be in both)."""
    tagged = C.tag_short(t.qrels, _short(t))
    return tagged.select("qid", F.when(F.col("is_short"), "short").otherwise("long").alias("cohort")).distinct()


RUN_SPLIT = ["""run_short AS (SELECT qid, doc_id, rank, score FROM bm25_run
  WHERE doc_id IN (SELECT doc_id FROM short) AND qid IN (SELECT qid FROM q_short))""",
             """run_long AS (SELECT qid, doc_id, rank, score FROM bm25_run
  WHERE doc_id NOT IN (SELECT doc_id FROM short) AND qid IN (SELECT qid FROM q_long))"""]


@register("c10_run_split", O.with_base(*COH, *BM25, *RUN_SPLIT, final="""
SELECT *, 'short' AS cohort FROM run_short UNION ALL SELECT *, 'long' FROM run_long"""))
def c10_run_split(t: Tables):
    """BM25 run split by the cohort of the document and of the query."""
    return C.tag_run(bm25_run(t), t.qrels, _short(t)).where("cohort IS NOT NULL")


@register("c10_run_report", O.with_base(*COH, *BM25, *RUN_SPLIT, final=_REPORT.format(o="bm25_run", s="run_short", l="run_long")))
def c10_run_report(t: Tables):
    """C8 pattern on the run split."""
    return C.tagged_report(C.tag_run(bm25_run(t), t.qrels, _short(t)))


TRIP_SPLIT = ["clean AS (SELECT * FROM triplets WHERE pos_id <> neg_id)",
              """tr_short AS (SELECT * FROM clean WHERE pos_id IN (SELECT doc_id FROM short) AND neg_id IN (SELECT doc_id FROM short))""",
              """tr_long AS (SELECT * FROM clean WHERE pos_id NOT IN (SELECT doc_id FROM short) AND neg_id NOT IN (SELECT doc_id FROM short))"""]


@register("c11_clean_triplets", O.with_base(*COH, *TRIPLETS, *TRIP_SPLIT, final="SELECT qid, pos_id, neg_id FROM clean"))
def c11_clean_triplets(t: Tables):
    """C11: triplets without positive == negative."""
    return C.clean_triplets(_triplets(t))


def _tagged_triplets(t: Tables):
    return C.tag_triplets(C.clean_triplets(_triplets(t)), _short(t))


@register("c12_triplet_split", O.with_base(*COH, *TRIPLETS, *TRIP_SPLIT, final="""
SELECT qid, pos_id, neg_id, 'short' AS cohort FROM tr_short UNION ALL SELECT qid, pos_id, neg_id, 'long' FROM tr_long"""))
def c12_triplet_split(t: Tables):
    """Triplets with both documents short / both long (mixed dropped)."""
    return _tagged_triplets(t).where("cohort IS NOT NULL")


@register("c13_train_queries", O.with_base(*COH, *TRIPLETS, *TRIP_SPLIT, final="""
SELECT DISTINCT qid, 'short' AS cohort FROM tr_short UNION ALL SELECT DISTINCT qid, 'long' FROM tr_long"""))
def c13_train_queries(t: Tables):
    """Training queries per triplet cohort."""
    return _tagged_triplets(t).where("cohort IS NOT NULL").select("qid", "cohort").distinct()


@register("c8_triplet_report", O.with_base(*COH, *TRIPLETS, *TRIP_SPLIT, final=_REPORT.format(o="clean", s="tr_short", l="tr_long")))
def c8_triplet_report(t: Tables):
    """C8 pattern on the triplet split."""
    return C.tagged_report(_tagged_triplets(t))


# ------------------------------------------------------------------ P

BEST = ["seg_run AS (SELECT qid, doc_id, psg + 1 AS segment, rank, score FROM psg_run)",
        """best AS (SELECT qid, doc_id,
   max(CASE WHEN rn = 1 THEN segment END) AS max_segment, max(CASE WHEN rn = 1 THEN score END) AS max_score,
   max(CASE WHEN rn = 2 THEN segment END) AS second_segment, max(CASE WHEN rn = 2 THEN score END) AS second_score
 FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, segment ASC) AS rn FROM seg_run)
 WHERE rn <= 2 GROUP BY qid, doc_id)"""]
BEST_COLS = "qid, doc_id, max_segment, max_score, second_segment, second_score, round(max_score - second_score, 6) AS diff"


def _best(t: Tables):
    return S.best_segments(S.parse_passage_run(psg_run(t)))


@register("p1_parse_run", O.with_base(*PSG_RUN, *BEST, final="SELECT qid, doc_id, segment, rank, score FROM seg_run"))
def p1_parse_run(t: Tables):
    """Passage run with 1-based segment numbers."""
    return S.parse_passage_run(psg_run(t))


@register("p2_best_segments", O.with_base(*PSG_RUN, *BEST, final=f"SELECT {BEST_COLS} FROM best"))
def p2_best_segments(t: Tables):
    """P2/P5 input: best and second-best segment of every retrieved pair."""
    return _best(t)


@register("p3_best_judged", O.with_base(*PSG_RUN, *BEST, final=f"""
SELECT {BEST_COLS} FROM best WHERE (qid, doc_id) IN (SELECT qid, doc_id FROM qrels)"""))
def p3_best_judged(t: Tables):
    """Best segments of judged pairs."""
    return S.judged_only(_best(t), t.qrels)


@register("p4_hist_judged", O.with_base(*PSG_RUN, *BEST, final="""
SELECT max_segment, count(*) AS n FROM best WHERE (qid, doc_id) IN (SELECT qid, doc_id FROM qrels)
GROUP BY max_segment ORDER BY n DESC, max_segment ASC LIMIT 20"""))
def p4_hist_judged(t: Tables):
    """Best-segment frequencies over judged pairs, top 20."""
    return S.best_segment_histogram(S.judged_only(_best(t), t.qrels))


@register("p5_hist_all", O.with_base(*PSG_RUN, *BEST, final="""
SELECT max_segment, count(*) AS n FROM best GROUP BY max_segment ORDER BY n DESC, max_segment ASC LIMIT 20"""))
def p5_hist_all(t: Tables):
    """P5: best-segment frequencies over all retrieved pairs, top 20."""
    return S.best_segment_histogram(_best(t))


# ------------------------------------------------------------------ V

SEG = ["seg_vec AS (SELECT doc_id, psg + 1 AS segment, term, w FROM impacts)",
       "doc_seg AS (SELECT DISTINCT doc_id, n_psg AS n_seg FROM passages)"]


def _seg(t: Tables):
    sv = t.impacts.select("doc_id", (F.col("psg") + 1).alias("segment"), "term", "w")
    ds = t.doc_lengths.select("doc_id", F.col("n_psg").alias("n_seg"))
    return sv, ds


def _ratios_sql() -> list[str]:
    def pm(segs):
        return " + ".join(f"(CASE WHEN d.n_seg >= {s} THEN {1 << (s - 1)} ELSE 0 END)" for s in segs)
    cols = ["count(*) FILTER (WHERE mask & 1 = 1) AS n1", "any_value(d.n_seg) AS n_seg"]
    for b in S.SHARED_WITH:
        cols.append(f"count(*) FILTER (WHERE mask & 1 = 1 AND mask & {1 << (b - 1)} <> 0) AS s_{b}")
    for o in S.OTHERS:
        tag = "_".join(map(str, o))
        cols.append(f"count(*) FILTER (WHERE mask & 1 = 1 AND mask & ({pm(o)}) = ({pm(o)})) AS g_{tag}")
        cols.append(f"count(*) FILTER (WHERE mask & 1 = 1 AND mask & ({pm(o)}) = 0) AS u_{tag}")
    per = f"""per AS (SELECT m.doc_id, {', '.join(cols)}
  FROM (SELECT doc_id, term, bit_or(1 << (segment - 1)) AS mask FROM seg_vec WHERE segment <= 6 GROUP BY doc_id, term) m
  JOIN doc_seg d USING (doc_id) GROUP BY m.doc_id HAVING count(*) FILTER (WHERE mask & 1 = 1) > 0)"""
    rows = []
    for b in S.SHARED_WITH:
        rows.append(f"SELECT doc_id, 'shared' AS measure, '1-{b}' AS others, CASE WHEN n_seg >= {b} THEN CAST(s_{b} AS DOUBLE) / n1 END AS ratio FROM per")
    for o in S.OTHERS:
        tag = "_".join(map(str, o))
        lab = "1-" + ",".join(map(str, o))
        rows.append(f"SELECT doc_id, 'global', '{lab}', CASE WHEN n_seg >= {min(o)} THEN CAST(g_{tag} AS DOUBLE) / n1 END FROM per")
        rows.append(f"SELECT doc_id, 'unique', '{lab}', CASE WHEN n_seg >= {min(o)} THEN CAST(u_{tag} AS DOUBLE) / n1 END FROM per")
    return [per, "ratios AS (" + " UNION ALL ".join(rows) + ")"]


RATIOS = SEG + _ratios_sql()


def _ratios(t: Tables):
    sv, ds = _seg(t)
    return S.term_ratios(sv, ds)


@register("v4_quantiles", O.with_base(*RATIOS, final="""
SELECT measure, others, p, min(ratio) AS value, any_value(n) AS n
FROM (SELECT measure, others, ratio, row_number() OVER (PARTITION BY measure, others ORDER BY ratio) AS r, count(*) OVER (PARTITION BY measure, others) AS n
      FROM ratios WHERE ratio IS NOT NULL), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p)
WHERE r >= ceil(p * n) GROUP BY measure, others, p"""))
def v4_quantiles(t: Tables):
    """V4 (violin shape): quantiles of every ratio by a mergeable sketch whose rank error is at most n / 100,000, none for
    fewer values than that."""
    return S.ratio_quantiles(_ratios(t))


@register("v1_v3_ratios", O.with_base(*RATIOS, final="SELECT doc_id, measure, others, round(ratio, 6) AS ratio FROM ratios"))
def v1_v3_ratios(t: Tables):
    """V1-V3: shared, global and unique term ratios of segment 1."""
    return _ratios(t).withColumn("ratio", F.round("ratio", 6))


@register("v4_summary", O.with_base(*RATIOS, final="""
SELECT measure, others, count(ratio) AS n, round(avg(ratio), 6) AS mean, round(stddev_samp(ratio), 6) AS std
FROM ratios GROUP BY measure, others"""))
def v4_summary(t: Tables):
    """V4: count, mean and sample standard deviation per ratio group."""
    return S.ratio_summary(_ratios(t))


@register("v5_znorm", O.with_base(*RATIOS, final="""
SELECT r.doc_id, r.measure, r.others, round(r.ratio, 6) AS ratio,
       round(CASE WHEN s.sd > 0 THEN (r.ratio - s.mu) / s.sd END, 6) AS z
FROM ratios r JOIN (SELECT measure, others, avg(ratio) AS mu, stddev_samp(ratio) AS sd FROM ratios GROUP BY measure, others) s
  USING (measure, others)"""))
def v5_znorm(t: Tables):
    """V5: z-normalised ratios next to the raw values."""
    z = S.z_normalise(_ratios(t))
    return z.select("doc_id", "measure", "others", F.round("ratio", 6).alias("ratio"), F.round("z", 6).alias("z"))


V6 = SEG + ["""v6 AS (SELECT * FROM seg_vec WHERE segment <= 3
  AND doc_id IN (SELECT doc_id FROM doc_seg WHERE n_seg > 2) AND doc_id IN (SELECT doc_id FROM qrels))""",
            "qtf AS (SELECT qid, term, count(*) AS qtf FROM query_tokens GROUP BY qid, term)",
            """matched AS (SELECT j.qid, v.doc_id, v.segment, v.term, v.w, q.qtf
  FROM v6 v JOIN (SELECT qid, doc_id FROM qrels WHERE rel >= 1) j USING (doc_id) JOIN qtf q ON q.qid = j.qid AND q.term = v.term)""",
            """vmask AS (SELECT qid, doc_id, term, bit_or(1 << (segment - 1)) AS mask FROM matched GROUP BY qid, doc_id, term)""",
            """shares AS (SELECT qid, doc_id,
  round(CASE WHEN sum(sc) > 0 THEN sum(CASE WHEN mask = 1 THEN sc ELSE 0 END) * 100.0 / sum(sc) END, 6) AS only_first,
  round(CASE WHEN sum(sc) > 0 THEN sum(CASE WHEN mask IN (3, 5) THEN sc ELSE 0 END) * 100.0 / sum(sc) END, 6) AS intersection,
  round(CASE WHEN sum(sc) > 0 THEN sum(CASE WHEN mask = 7 THEN sc ELSE 0 END) * 100.0 / sum(sc) END, 6) AS global_term
  FROM (SELECT m.qid, m.doc_id, m.term, m.w * m.qtf AS sc, k.mask FROM matched m JOIN vmask k USING (qid, doc_id, term) WHERE m.segment = 1)
  GROUP BY qid, doc_id)"""]


def _matched(t: Tables):
    sv, ds = _seg(t)
    v6 = S.first_three_segments(sv, ds, t.qrels)
    qtf = t.query_tokens.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return v6, S.with_queries(v6, t.qrels, qtf)


@register("v6_first3", O.with_base(*V6, final="SELECT doc_id, segment, term, w FROM v6"))
def v6_first3(t: Tables):
    """V6: judged documents with > 2 segments, segments 1..3."""
    return _matched(t)[0]


@register("v7_with_queries", O.with_base(*V6, final="SELECT qid, doc_id, segment, term, w, qtf FROM matched"))
def v7_with_queries(t: Tables):
    """V7: segment vectors joined with judgements and query terms."""
    return _matched(t)[1]


@register("v8_venn", O.with_base(*V6, final="SELECT qid, doc_id, mask, count(*) AS n_terms FROM vmask GROUP BY qid, doc_id, mask"))
def v8_venn(t: Tables):
    """V8: query-term counts per presence region of segments 1..3."""
    return S.venn_regions(_matched(t)[1])


@register("v9_shares", O.with_base(*V6, final="SELECT * FROM shares"))
def v9_shares(t: Tables):
    """V9: share of the segment-1 score per region."""
    return S.region_shares(_matched(t)[1])


@register("v10_influence", O.with_base(*V6, final="""
SELECT round(sum(only_first) * 100.0 / (sum(only_first) + sum(intersection) + sum(global_term)), 4) AS only_first,
       round(sum(intersection) * 100.0 / (sum(only_first) + sum(intersection) + sum(global_term)), 4) AS intersection,
       round(sum(global_term) * 100.0 / (sum(only_first) + sum(intersection) + sum(global_term)), 4) AS global_term
FROM shares"""))
def v10_influence(t: Tables):
    """Overall influence of each region."""
    return S.influence(S.region_shares(_matched(t)[1]))


@register("v11_presence", O.with_base(*SEG, final="""
SELECT doc_id, mask, count(*) AS n_terms FROM (
  SELECT doc_id, term, bit_or(1 << (segment - 1)) AS mask FROM seg_vec WHERE segment <= 3 GROUP BY doc_id, term)
GROUP BY doc_id, mask"""))
def v11_presence(t: Tables):
    """Term counts per presence region of segments 1..3."""
    return S.presence_regions(_seg(t)[0])


@register("v12_sample", O.with_base(*COH, final="""
SELECT doc_id, n_psg FROM doc_len WHERE CAST(('0x' || substr(md5(doc_id), 1, 8)) AS BIGINT) % 100 < 10"""))
def v12_sample(t: Tables):
    """Deterministic 10% document sample (md5-based)."""
    return S.sample_documents(C.passages_per_doc(t.passages), 10)
