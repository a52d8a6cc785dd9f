"""Registered queries: retrieval, runs and metrics (R*, F*, M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from segrank.operators import metrics as M
from segrank.operators import retrieve as R
from segrank.operators import runs as RU
from segrank.plans import oracle as O
from segrank.plans.catalog import FLAGSHIP_N, flagship_run, register
from segrank.plans.derived import Tables

BM25_N = None  # lexical runs index all passages of every document

DOT_RUN = [f"doc_vec AS ({O.doc_agg_sql('max', FLAGSHIP_N)})",
           f"run AS ({O.dot_run_sql('query_impacts', 'doc_vec', 1000)})"]
BM25 = O.bm25_ctes(BM25_N) + [f"bm25_run AS ({O.bm25_run_sql(BM25_N, 1000)})"]
PSG_RUN = [f"psg_run AS ({O.topk_sql('''(SELECT qid, doc_id, psg, round(CAST(sum(qw * w) AS DOUBLE), 6) AS score FROM query_impacts JOIN impacts USING (term) GROUP BY qid, doc_id, psg)''', 10000).replace('ORDER BY score DESC, doc_id ASC', 'ORDER BY score DESC, doc_id ASC, psg ASC')})"]


def bm25_run(t: Tables):
    """The stored BM25 run (top 1000 over whole documents)."""
    return t.bm25_top


def psg_run(t: Tables, k: int = 10000):
    return R.retrieve_passages_first(t.postings, t.query_impacts, t.lexicon, t.weight, k)


@register("r2_dot_run", O.with_base(*DOT_RUN, final="SELECT qid, doc_id, rank, score FROM run"))
def r2_dot_run(t: Tables):
    """R2: top-1000 documents by dot product (max of the first 4 passages)."""
    return flagship_run(t)


@register("r3_passage_run", O.with_base(*PSG_RUN, final="SELECT qid, doc_id, psg, rank, score FROM psg_run"))
def r3_passage_run(t: Tables):
    """Top-10000 passages per query."""
    return psg_run(t)


@register("r4_bm25_run", O.with_base(*BM25, final="SELECT qid, doc_id, rank, score FROM bm25_run"))
def r4_bm25_run(t: Tables):
    """BM25 (k1 0.9, b 0.4) over whole documents, top 1000."""
    return R.bm25(t, t.query_tokens, 1000)


def rm3_ctes(n: int | None, p: str = "bm") -> list[str]:
    """RM3 on first-n documents: ``{p}_mixed(qid, term, qweight)``."""
    return O.bm25_ctes(n, p) + [
        f"{p}_fb AS (SELECT qid, doc_id, score, score / sum(score) OVER (PARTITION BY qid) AS sn FROM ({O.bm25_run_sql(n, 10, prefix=p)}))",
        f"""{p}_fb_tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM {p}_tok
               WHERE doc_id IN (SELECT doc_id FROM {p}_fb) GROUP BY doc_id, term)""",
        f"{p}_rm AS (SELECT qid, term, round(sum(sn * tf / dl), 9) AS p FROM {p}_fb JOIN {p}_fb_tf USING (doc_id) GROUP BY qid, term)",
        f"""{p}_rm_top AS (SELECT qid, term, p / sum(p) OVER (PARTITION BY qid) AS p FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, term ASC) AS rn FROM {p}_rm) WHERE rn <= 10)""",
        f"{p}_qm AS (SELECT qid, term, qweight / sum(qweight) OVER (PARTITION BY qid) AS p FROM {O.QTF})",
        f"""{p}_mixed AS (SELECT coalesce(a.qid, c.qid) AS qid, coalesce(a.term, c.term) AS term,
      coalesce(0.5 * a.p, 0.0) + coalesce(0.5 * c.p, 0.0) AS qweight
      FROM {p}_qm a FULL OUTER JOIN {p}_rm_top c ON a.qid = c.qid AND a.term = c.term)"""]


def rm3_run_sql(n: int | None, p: str = "bm") -> str:
    return O.bm25_run_sql(n, 1000, f"{p}_mixed", prefix=p)


@register("r5_rm3_run", O.with_base(*rm3_ctes(BM25_N), final=f"SELECT qid, doc_id, rank, score FROM ({rm3_run_sql(BM25_N)})"))
def r5_rm3_run(t: Tables):
    """BM25 + RM3 (10 feedback docs, 10 terms, original weight 0.5)."""
    return R.rm3(t, t.query_tokens, 1000)


def sdm_ctes(n: int | None, p: str = "bm") -> list[str]:
    """The weighted parts of the dependence model on first-n documents."""
    return O.bm25_ctes(n, p) + [
        f"{p}_uni AS (SELECT qid, doc_id, {O.dbl(0.85)} * s AS s FROM ({O.bm25_unit_sql(O.term_units_sql(O.QTF, p + '_tok'), p + '_stats')}))",
        f"{p}_od AS (SELECT qid, doc_id, {O.dbl(0.15)} * s AS s FROM ({O.bm25_unit_sql(O.pair_units_sql(p + '_tok', None), p + '_stats')}))",
        f"{p}_uw AS (SELECT qid, doc_id, {O.dbl(0.05)} * s AS s FROM ({O.bm25_unit_sql(O.pair_units_sql(p + '_tok', 8), p + '_stats')}))"]


def sdm_run_sql(p: str = "bm") -> str:
    return O.topk_sql(f"""(SELECT qid, doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM {p}_uni UNION ALL SELECT * FROM {p}_od
UNION ALL SELECT * FROM {p}_uw) GROUP BY qid, doc_id)""", 1000)


@register("r6_sdm_run", O.with_base(*sdm_ctes(BM25_N), final=f"SELECT qid, doc_id, rank, score FROM ({sdm_run_sql()})"))
def r6_sdm_run(t: Tables):
    """Sequential-dependence BM25 (0.85 / 0.15 / 0.05, window 8)."""
    return R.sdm_bm25(t, t.query_tokens, 1000)


def _sweep_sql(max_n: int, ctes, run) -> str:
    """Metrics of ``max_n`` separate runs."""
    ns = range(1, max_n + 1)
    return O.with_base(*[c for n in ns for c in ctes(n, f"b{n}")], final=" UNION ALL ".join(
        f"SELECT {n} AS n, * FROM ({O.summary_sql('(' + run(n, f'b{n}') + ')')})" for n in ns))


def _evaluated(t: Tables, runs, max_n: int):
    return M.summary(runs, t.qrels, group=("n",), groups=list(range(1, max_n + 1)))


@register("r7_bm25_sweep", _sweep_sql(10, O.bm25_ctes, lambda n, p: O.bm25_run_sql(n, 1000, prefix=p)))
def r7_bm25_sweep(t: Tables):
    """BM25 over the first n = 1..10 passages in one pass; metrics per n."""
    return _evaluated(t, R.bm25(t, t.query_tokens, 1000, list(range(1, 11))), 10)


@register("r7_rm3_sweep", _sweep_sql(10, rm3_ctes, rm3_run_sql))
def r7_rm3_sweep(t: Tables):
    """R7 with feedback, as the jobs run it: RM3 over the first n = 1..10 passages; metrics per n."""
    return _evaluated(t, R.rm3(t, t.query_tokens, 1000, list(range(1, 11))), 10)


@register("r7_sdm_sweep", _sweep_sql(5, sdm_ctes, lambda n, p: sdm_run_sql(p)))
def r7_sdm_sweep(t: Tables):
    """R7 with dependence features: n = 1..5; metrics per n."""
    return _evaluated(t, R.sdm_bm25(t, t.query_tokens, 1000, list(range(1, 6))), 5)


@register("r1_postings", O.with_base(final="""
SELECT term, doc_id, CAST(sum(tf) AS BIGINT) AS tf, any_value(n_psg) AS n_psg, CAST(any_value(dl) AS INTEGER) AS dl, any_value(df) AS df,
       string_agg(psg || ':' || tf, ' ' ORDER BY psg) AS hits
FROM (SELECT doc_id, n_psg, psg, term, count(*) AS tf FROM tokens GROUP BY doc_id, n_psg, psg, term)
JOIN (SELECT doc_id, sum(n_tok) AS dl FROM passages GROUP BY doc_id) USING (doc_id) JOIN term_df USING (term)
GROUP BY term, doc_id"""))
def r1_postings(t: Tables):
    """The stored postings, one row for each (term, document)."""
    return t.postings.select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"), "n_psg", "dl", "df", F.array_join(F.transform(
        "hits", lambda h: F.concat_ws(":", h["psg"].cast("string"), h["tf"].cast("string"))), " ").alias("hits"))


@register("r1_lexicon", O.with_base("""firsts AS (SELECT term, doc_id, min(psg) AS p, count(*) AS tf FROM tokens GROUP BY term, doc_id)""", final="""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, count(CASE WHEN p < 1 THEN 1 END) AS df_1, count(CASE WHEN p < 3 THEN 1 END) AS df_3,
       count(CASE WHEN p < 10 THEN 1 END) AS df_10 FROM firsts GROUP BY term"""))
def r1_lexicon(t: Tables):
    """Document frequencies, of whole documents and of their first 1, 3 and 10 passages, from one count of first passages."""
    return t.lexicon.select("term", "df", "cf", *[F.col("dfs")[n - 1].alias(f"df_{n}") for n in (1, 3, 10)])


@register("a7_sweep_eval", O.with_base(*[f"v_{mode}_{n} AS ({O.doc_agg_sql(mode, n)})" for mode in ("max", "sum", "mean") for n in range(1, 11)],
                                       final=" UNION ALL ".join(
    f"SELECT '{mode}' AS mode, {n} AS n, * FROM ({O.summary_sql('(' + O.dot_run_sql('query_impacts', f'v_{mode}_{n}', 1000) + ')')})"
    for mode in ("max", "sum", "mean") for n in range(1, 11))))
def a7_sweep_eval(t: Tables):
    """A7 as the jobs run it: document vectors by max, sum and mean of the first n = 1..10 passages, each retrieved (top
    1000) and evaluated, in one pass over the postings."""
    ns = list(range(1, 11))
    runs = R.vector_sweep(t.postings, t.query_impacts, t.lexicon, t.weight, ns)
    return M.summary(runs, t.qrels, group=("mode", "n"), groups=[(m, n) for m in ("max", "sum", "mean") for n in ns])


# ------------------------------------------------------------------ runs (F)

F1_SQL = """
SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY src_rank) AS INTEGER) AS rank, src_rank, score
FROM (SELECT qid, doc_id, min(rank) AS src_rank, arg_min(score, rank) AS score FROM psg_run WHERE psg < 3 GROUP BY qid, doc_id)
QUALIFY rank <= 1000"""


@register("f1_maxpsg_run", O.with_base(*PSG_RUN, final=F1_SQL))
def f1_maxpsg_run(t: Tables):
    """passage run -> document run by best passage among the first 3."""
    return RU.max_passage_run(psg_run(t), 3)


@register("f2_maxpsg_sweep", O.with_base(*PSG_RUN, final="""
SELECT CAST(n AS INTEGER) AS n, count(DISTINCT qid) AS n_queries, count(*) AS n_rows, round(sum(score), 3) AS total_score
FROM (SELECT n, qid, doc_id, arg_min(score, rank) AS score, min(rank) AS src_rank
      FROM psg_run, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 10]) AS n) WHERE psg < n GROUP BY n, qid, doc_id
      QUALIFY row_number() OVER (PARTITION BY n, qid ORDER BY src_rank) <= 1000)
GROUP BY n"""))
def f2_maxpsg_sweep(t: Tables):
    """F1 for n in 1..7 and 10 in one job, summarised per n."""
    sw = RU.max_passage_sweep(psg_run(t))
    return sw.groupBy("n").agg(F.countDistinct("qid").alias("n_queries"), F.count(F.lit(1)).alias("n_rows"),
                               F.round(F.sum("score"), 3).alias("total_score"))


F2_NS = (1, 2, 3, 4, 5, 6, 7, 10)


def _f2_run_sql(n: int) -> str:
    return f"""(SELECT qid, doc_id, arg_min(score, rank) AS score, min(rank) AS src_rank FROM psg_run WHERE psg < {n}
      GROUP BY qid, doc_id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY src_rank) <= 1000)"""


@register("f2_sweep_eval", O.with_base(*PSG_RUN, final=" UNION ALL ".join(
    f"SELECT {n} AS n, * FROM ({O.summary_sql(_f2_run_sql(n), k_rec=100)})" for n in F2_NS)))
def f2_sweep_eval(t: Tables):
    """F2 + M1-M3: MRR@10, nDCG@10 and recall@100 of the best-passage run for every n."""
    return M.summary(RU.max_passage_sweep(psg_run(t), F2_NS), t.qrels, k_recall=100, group=("n",), groups=list(F2_NS))


@register("f4_prune200", O.with_base(*BM25, final="SELECT qid, doc_id, rank, score FROM bm25_run WHERE rank <= 200"))
def f4_prune200(t: Tables):
    """first 200 rows per query of the BM25 run."""
    return RU.cut(bm25_run(t), 200)


@register("f5_avg_rank", O.with_base(*DOT_RUN, final="""
SELECT qid, doc_id, rank, score,
  CAST(rank() OVER (PARTITION BY qid ORDER BY score DESC) + (count(*) OVER (PARTITION BY qid, score) - 1) / 2.0 AS DOUBLE) AS avg_rank
FROM run"""))
def f5_avg_rank(t: Tables):
    """rank by score with the average rank for ties."""
    return RU.average_rank(flagship_run(t))


@register("f6_lookup", O.with_base(*(DOT_RUN + BM25), final="""
SELECT k.qid, k.doc_id, a.avg_rank AS dot_rank, a.score AS dot_score, b.avg_rank AS bm25_rank, b.score AS bm25_score
FROM (SELECT DISTINCT qid, doc_id FROM qrels) k
LEFT JOIN (SELECT qid, doc_id, score, rank() OVER (PARTITION BY qid ORDER BY score DESC) + (count(*) OVER (PARTITION BY qid, score) - 1) / 2.0 AS avg_rank FROM run) a
  ON a.qid = k.qid AND a.doc_id = k.doc_id
LEFT JOIN (SELECT qid, doc_id, score, rank() OVER (PARTITION BY qid ORDER BY score DESC) + (count(*) OVER (PARTITION BY qid, score) - 1) / 2.0 AS avg_rank FROM bm25_run) b
  ON b.qid = k.qid AND b.doc_id = k.doc_id"""))
def f6_lookup(t: Tables):
    """rank and score of every judged document in two runs."""
    return RU.lookup_in_runs({"dot": flagship_run(t), "bm25": bm25_run(t)}, t.qrels)


@register("f7_restrict", O.with_base(*(DOT_RUN + BM25), final="""
SELECT qid, doc_id, rank, score FROM run WHERE (qid, doc_id) IN (SELECT qid, doc_id FROM bm25_run)"""))
def f7_restrict(t: Tables):
    """dot-product run restricted to documents the BM25 run also found."""
    return RU.restrict_to(flagship_run(t), bm25_run(t))


@register("f8_judged_of_query", O.with_base(final="""
SELECT qid, doc_id, rel FROM qrels WHERE qid = (SELECT min(qid) FROM qrels)"""))
def f8_judged_of_query(t: Tables):
    """F8: judged documents of one query (the smallest judged query id)."""
    return RU.judged_docs(t.qrels, t.qrels.agg(F.min("qid")).scalar())


@register("f9_sorted", O.with_base(*DOT_RUN, final="SELECT qid, doc_id, rank, score FROM run ORDER BY doc_id, score DESC"))
def f9_sorted(t: Tables):
    """run ordered by document ascending, score descending."""
    return RU.sort_doc_score(flagship_run(t))


# --------------------------------------------------------------- metrics (M)

@register("m4_per_query", O.with_base(*DOT_RUN, final=
    "SELECT qid, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM (" + O.per_query_sql("run") + ")"))
def m4_per_query(t: Tables):
    """M4: per-query RR@10, nDCG@10 and recall@1000 of the dot-product run."""
    pq = M.per_query(flagship_run(t), t.qrels)
    return pq.select("qid", *[F.round(c, 6).alias(c) for c in ("rr", "ndcg", "recall")])


@register("m1_m3_bm25_eval", O.with_base(*BM25, final=O.summary_sql("bm25_run")))
def m1_m3_bm25_eval(t: Tables):
    """M1-M3 on the BM25 run."""
    return M.summary(bm25_run(t), t.qrels)


@register("m3_recall100", O.with_base(*BM25, final=O.summary_sql("bm25_run", k_rec=100)))
def m3_recall100(t: Tables):
    """M3 with k = 100."""
    return M.summary(bm25_run(t), t.qrels, k_recall=100)


_M5_SQL = f"""
SELECT n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_diff, 6) AS mean_diff,
       round(sd_diff, 6) AS sd_diff, round(CASE WHEN sd_diff > 1e-12 THEN mean_diff / (sd_diff / sqrt(n)) END, 6) AS t_stat
FROM (SELECT count(*) AS n, avg(a.rr) AS mean_a, avg(b.rr) AS mean_b, avg(a.rr - b.rr) AS mean_diff,
             stddev_samp(a.rr - b.rr) AS sd_diff
      FROM ({O.per_query_sql('run')}) a JOIN ({O.per_query_sql('bm25_run')}) b USING (qid))"""


@register("m5_ttest", O.with_base(*(DOT_RUN + BM25), final=_M5_SQL))
def m5_ttest(t: Tables):
    """M5: paired t statistic, dot-product run vs BM25 run on RR@10."""
    return M.paired_t(M.per_query(flagship_run(t), t.qrels), M.per_query(bm25_run(t), t.qrels))


@register("m5_pvalue", O.with_base(
    *(DOT_RUN + BM25), f"m5 AS ({_M5_SQL})",
    "m5t AS (SELECT n, t_stat, n - 1 AS v, atan(abs(t_stat) / sqrt(n - 1)) AS th, CAST(n - 1 AS DOUBLE) / (n - 1 + t_stat * t_stat) AS c2 FROM m5)",
    """m5k AS (SELECT exp(sum(ln(CASE WHEN v % 2 = 0 THEN CAST(2 * k - 1 AS DOUBLE) / (2 * k) ELSE CAST(2 * k AS DOUBLE) / (2 * k + 1) END * c2)) OVER (ORDER BY k)) AS a
      FROM (SELECT v, c2, unnest(range(1, CASE WHEN v % 2 = 0 THEN v // 2 ELSE (v - 1) // 2 END)) AS k FROM m5t))""",
    final="""SELECT n, t_stat, round(CASE WHEN v % 2 = 0 THEN 1 - sin(th) * total WHEN v = 1 THEN 1 - 2 * th / pi()
       ELSE 1 - 2 / pi() * (th + sin(th) * cos(th) * total) END, 6) + 0.0 AS p_value
FROM (SELECT *, 1 + coalesce((SELECT sum(a) FROM m5k), 0) AS total FROM m5t)"""))
def m5_pvalue(t: Tables):
    """M5: paired t statistic and its two-sided p-value, dot-product run vs BM25 run on RR@10."""
    row = M.paired_t(M.per_query(flagship_run(t), t.qrels), M.per_query(bm25_run(t), t.qrels))
    return row.select("n", "t_stat", F.round(M.t_pvalue_column(F.col("t_stat"), F.col("n")), 6).alias("p_value"))
