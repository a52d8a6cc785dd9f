"""Registered queries: candidate assembly and SDM reranking (K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from segrank.operators import metrics as M
from segrank.operators import sdm as K
from segrank.plans import oracle as O
from segrank.plans.catalog import register
from segrank.plans.derived import Tables
from segrank.operators import runs as RU
from segrank.plans.queries_retrieval import BM25, F1_SQL, PSG_RUN, bm25_run, psg_run
from segrank.plans.util import small
from segrank.session import cut_lineage

CAND_K = 200      # candidates reranked per query
N_PSG = 2         # passages per candidate for the single-config queries
EXACT = K.SdmConfig(exact=True, windows=(1, 2), proximity=8, n_psg=N_PSG)
SOFT = K.SdmConfig(exact=False, windows=(1, 5), proximity=10, n_psg=N_PSG)

CAND = BM25 + [f"cand AS (SELECT qid, doc_id, rank FROM bm25_run WHERE rank <= {CAND_K})"]


def _cand(t: Tables):
    return K.candidates(bm25_run(t), CAND_K)


def _rows(t: Tables, n_psg: int, cand):
    # the candidates' passages and the queries' positions are read twice, so they are kept; the documents are read once
    docs = small(cand.select("doc_id").distinct())
    psgs = cut_lineage(t.passage_terms.where(F.col("psg") < n_psg).join(docs, "doc_id", "left_semi"))
    wanted, slots = cut_lineage(K.candidate_terms(cand, psgs, n_psg)), cut_lineage(t.query_slots)
    return K.match_rows(cand, psgs, K.expansion_of(wanted, slots, t.expansion_between(wanted, slots.select("qid", "term"))), n_psg)


def pooled(t: Tables, cfg: K.SdmConfig, cand=None):
    cand = _cand(t) if cand is None else cand
    return cand, K.pooled_features(K.passage_features(_rows(t, cfg.n_psg, cand), cfg), cand, cfg)


def _triplets(t: Tables):
    """Positives from the judgements, negatives = all documents of the query's
    BM25 run that are not judged, and the positive itself where the run has
    it (those rows exercise C11)."""
    pos = t.qrels.filter(F.col("rel") > 0).select("qid", F.col("doc_id").alias("pos_id"))
    judged = t.qrels.select("qid", F.col("doc_id").alias("neg_id"), F.lit(True).alias("judged")).distinct()
    neg = bm25_run(t).select("qid", F.col("doc_id").alias("neg_id")).join(judged, ["qid", "neg_id"], "left")
    # the run is small and the judgements, which grow, are dealt to tasks: no task gets all triplets of a query
    pos = pos.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "pos_id")
    return (pos.join(small(neg), "qid").filter(F.col("judged").isNull() | (F.col("pos_id") == F.col("neg_id")))
            .select("qid", "pos_id", "neg_id"))


TRIPLETS = BM25 + ["""triplets AS (SELECT p.qid, p.doc_id AS pos_id, n.doc_id AS neg_id
  FROM (SELECT qid, doc_id FROM qrels WHERE rel > 0) p JOIN (SELECT r.qid, r.doc_id, j.doc_id IS NOT NULL AS judged FROM bm25_run r LEFT JOIN (SELECT DISTINCT qid, doc_id FROM qrels) j
    ON j.qid = r.qid AND j.doc_id = r.doc_id) n USING (qid) WHERE NOT n.judged OR n.doc_id = p.doc_id)"""]


@register("k1_pairs", O.with_base(*CAND, final=f"""
SELECT c.qid, c.doc_id, c.rank, q.text AS query, p.psg, p.text
FROM cand c JOIN queries q USING (qid) LEFT JOIN (SELECT doc_id, psg, text FROM passages WHERE psg < {N_PSG}) p USING (doc_id)"""))
def k1_pairs(t: Tables):
    """K1: (query, candidate, passage) rows for the top-200 BM25 candidates."""
    return K.pair_table(bm25_run(t), t.queries, t.passages, CAND_K, N_PSG)


@register("k2_triplet_passages", O.with_base(*TRIPLETS, final=f"""
SELECT x.qid, x.pos_id, x.neg_id, x.role, x.doc_id, p.psg, p.text
FROM (SELECT qid, pos_id, neg_id, 'pos' AS role, pos_id AS doc_id FROM triplets
      UNION ALL SELECT qid, pos_id, neg_id, 'neg', neg_id FROM triplets) x
JOIN (SELECT doc_id, psg, text FROM passages WHERE psg < {N_PSG}) p USING (doc_id)
WHERE x.pos_id IN (SELECT doc_id FROM passages) AND x.neg_id IN (SELECT doc_id FROM passages)"""))
def k2_triplet_passages(t: Tables):
    """K2 (+S6): triplets whose documents exist, with the first 2 passages
    of the positive and the negative."""
    tr = K.clean_triplets(_triplets(t), t.passages)
    return K.triplet_passages(tr, t.passages, N_PSG)


@register("k3_text_triplets", O.with_base(*TRIPLETS, final="""
SELECT t.qid, t.pos_id, t.neg_id, q.text AS query, a.text AS pos, b.text AS neg
FROM triplets t JOIN queries q USING (qid) JOIN corpus a ON a.doc_id = t.pos_id JOIN corpus b ON b.doc_id = t.neg_id"""))
def k3_text_triplets(t: Tables):
    """K3: triplets with the query and both document texts."""
    return K.text_triplets(_triplets(t), t.queries, t.corpus)


@register("k4_soft_cells", O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", N_PSG), final="""
SELECT k.qid, k.doc_id, k.psg, CAST(i AS INTEGER) AS i, count(*) AS n_cells, CAST(sum(j) AS BIGINT) AS sum_j, round(sum(m), 6) AS sum_m,
       round(max(m), 6) AS max_m FROM s_cells_soft c JOIN s_keys k ON k.pid = c.pid GROUP BY k.qid, k.doc_id, k.psg, i"""))
def k4_soft_cells(t: Tables):
    """K4: all soft match cells through the whole expansion table, summed over the document positions."""
    return K.cells(_rows(t, N_PSG, _cand(t))).groupBy("qid", "doc_id", "psg", "i").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("j").alias("sum_j"), F.round(F.sum("m"), 6).alias("sum_m"), F.round(F.max("m"), 6).alias("max_m"))


@register("k5_exact_cells", O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", N_PSG), final="""
SELECT k.qid, k.doc_id, k.psg, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(m, 6) AS m
FROM s_cells_exact c JOIN s_keys k ON k.pid = c.pid"""))
def k5_exact_cells(t: Tables):
    """K5: exact match cells (document token equals query token)."""
    return K.cells(_rows(t, N_PSG, _cand(t))).where("same").select("qid", "doc_id", "psg", "i", "j", F.round("m", 6).alias("m"))


@register("k12_passage_features_exact", O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", N_PSG), final=
    "SELECT qid, doc_id, psg, feature, round(value, 6) AS value FROM (" + O.passage_features_sql("s", True, (1, 2), 8) + ")"))
def k12_passage_features_exact(t: Tables):
    """K6-K12 exact variant (windows 1, 2; proximity 8), per passage."""
    return K.passage_features(_rows(t, N_PSG, _cand(t)), EXACT).withColumn("value", F.round("value", 6))


@register("k12_passage_features_soft", O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", N_PSG), final=
    "SELECT qid, doc_id, psg, feature, round(value, 6) AS value FROM (" + O.passage_features_sql("s", False, (1, 5), 10) + ")"))
def k12_passage_features_soft(t: Tables):
    """K6-K12 soft variant (windows 1, 5; proximity 10), per passage."""
    return K.passage_features(_rows(t, N_PSG, _cand(t)), SOFT).withColumn("value", F.round("value", 6))


@register("k13_pooled_exact", O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", N_PSG), final=
    "SELECT qid, doc_id, feature, round(value, 6) AS value FROM (" +
    O.pooled_sql(O.passage_features_sql("s", True, (1, 2), 8), "cand", EXACT.feature_names) + ")"))
def k13_pooled_exact(t: Tables):
    """Per-feature max over the first 2 passages (exact, 1-2, P 8)."""
    return pooled(t, EXACT)[1].withColumn("value", F.round("value", 6))


@register("k13_pooled_soft", O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", N_PSG), final=
    "SELECT qid, doc_id, feature, round(value, 6) AS value FROM (" +
    O.pooled_sql(O.passage_features_sql("s", False, (1, 5), 10), "cand", SOFT.feature_names) + ")"))
def k13_pooled_soft(t: Tables):
    """K13 for the soft variant (1-5, P 10)."""
    return pooled(t, SOFT)[1].withColumn("value", F.round("value", 6))


def _weights_sql(cfg: K.SdmConfig) -> str:
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, {O.dbl(w)} AS weight" for f, w in K.default_weights(cfg).items())
    return f"fw AS ({rows})"


def _rerank_sql(cfg: K.SdmConfig) -> str:
    pooled_q = O.pooled_sql(O.passage_features_sql("s", cfg.exact, cfg.windows, cfg.proximity), "cand", cfg.feature_names)
    return f"""SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id ASC) AS INTEGER) AS rank, score
FROM (SELECT qid, doc_id, round(sum(weight * value) + 0.0, 6) AS score FROM ({pooled_q}) JOIN fw USING (feature) GROUP BY qid, doc_id)"""


def reranked(t: Tables, cfg: K.SdmConfig, cand=None):
    cand, pool = pooled(t, cfg, cand)
    fused = K.fuse(pool, K.weights_frame(t.spark, K.default_weights(cfg)))
    return K.rerank(cand, fused)


@register("k16_rerank_exact", O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", N_PSG), _weights_sql(EXACT),
                                           final=_rerank_sql(EXACT)))
def k16_rerank_exact(t: Tables):
    """K14 + K16: fused score (fixed weights) -> reranked run."""
    return reranked(t, EXACT)


@register("k16_rerank_exact_eval", O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", N_PSG), _weights_sql(EXACT),
                                                f"rr AS ({_rerank_sql(EXACT)})", final=O.summary_sql("rr")))
def k16_rerank_exact_eval(t: Tables):
    """MRR@10 / nDCG@10 / recall of the reranked run."""
    return M.summary(reranked(t, EXACT), t.qrels)


@register("k16_rerank_soft_eval", O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", N_PSG), _weights_sql(SOFT),
                                               f"rr AS ({_rerank_sql(SOFT)})", final=O.summary_sql("rr")))
def k16_rerank_soft_eval(t: Tables):
    """K16 + K18 for the soft variant."""
    return M.summary(reranked(t, SOFT), t.qrels)


@register("k16_rerank_maxpsg_eval", O.with_base(
    O.EXPANSION, *PSG_RUN, f"cand AS (SELECT qid, doc_id, rank FROM ({F1_SQL}) WHERE rank <= {CAND_K})",
    *O.sdm_ctes("cand", N_PSG), _weights_sql(EXACT), f"rr AS ({_rerank_sql(EXACT)})", final=O.summary_sql("rr")))
def k16_rerank_maxpsg_eval(t: Tables):
    """F1 + F4 + K16: the first 200 documents of the best-passage run, reranked and evaluated."""
    cand = cut_lineage(K.candidates(RU.max_passage_run(psg_run(t), 3), CAND_K))      # read several times
    return M.summary(reranked(t, EXACT, cand), t.qrels)


def triplet_differences(t: Tables, cfg: K.SdmConfig = EXACT):
    tr = K.clean_triplets(_triplets(t), t.doc_lengths).filter(F.col("pos_id") != F.col("neg_id"))
    pairs = cut_lineage(tr.select("qid", F.explode(F.array("pos_id", "neg_id")).alias("doc_id")).distinct())
    feats = K.pooled_features(K.passage_features(_rows(t, cfg.n_psg, pairs), cfg), pairs, cfg)
    return K.feature_differences(feats, tr, cfg.feature_names)


FIT_STEPS, FIT_REG, FIT_TOL = 25, 1e-3, 1e-9


def _fit_sql() -> list[str]:
    """The same descent in SQL, step by step, for the three features of the exact configuration: ``w{k}(a, b, c)`` are the weights
    before step k, ``s{k}`` the loss, gradient and curvature there (Cramer's rule solves for the step)."""
    r = FIT_REG
    features = O.passage_features_sql("t", True, (1, 2), 8)
    wide = ", ".join(f"coalesce(max(CASE WHEN feature = '{f}' THEN value END), 0.0) AS v{k}" for k, f in enumerate(EXACT.feature_names))
    out = [*TRIPLETS,
           """fit_tr AS (SELECT * FROM triplets WHERE pos_id <> neg_id AND pos_id IN (SELECT doc_id FROM passages)
  AND neg_id IN (SELECT doc_id FROM passages))""",
           "fit_pairs AS (SELECT qid, pos_id AS doc_id FROM fit_tr UNION SELECT qid, neg_id FROM fit_tr)",
           *O.sdm_ctes("fit_pairs", N_PSG, "t"),
           f"""fit_f AS MATERIALIZED (SELECT p.qid, p.doc_id, {wide} FROM fit_pairs p LEFT JOIN ({features}) f ON f.qid = p.qid AND f.doc_id = p.doc_id
  GROUP BY p.qid, p.doc_id)""",
           """fit_d AS MATERIALIZED (SELECT p.v0 - n.v0 AS d0, p.v1 - n.v1 AS d1, p.v2 - n.v2 AS d2 FROM fit_tr x
  JOIN fit_f p ON p.qid = x.qid AND p.doc_id = x.pos_id JOIN fit_f n ON n.qid = x.qid AND n.doc_id = x.neg_id)""",
           "w0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, false AS done)"]
    for k in range(FIT_STEPS):
        out.append(f"""s{k} AS MATERIALIZED (SELECT *, greatest(abs(g0), abs(g1), abs(g2)) < {FIT_TOL} AS met,
  h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
FROM (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(done) AS done, avg(loss) AS loss,
  -avg(p * d0) + {r} * any_value(a) AS g0, -avg(p * d1) + {r} * any_value(b) AS g1, -avg(p * d2) + {r} * any_value(c) AS g2,
  avg(q * d0 * d0) + {r} AS h00, avg(q * d0 * d1) AS h01, avg(q * d0 * d2) AS h02, avg(q * d1 * d1) + {r} AS h11, avg(q * d1 * d2) AS h12,
  avg(q * d2 * d2) + {r} AS h22
 FROM (SELECT *, p * (1 - p) AS q FROM (SELECT *, 1 / (1 + exp(z)) AS p, ln(1 + exp(-z)) AS loss
  FROM (SELECT *, greatest(least(a * d0 + b * d1 + c * d2, 500.0), -500.0) AS z FROM fit_d, w{k})))))""")
        out.append(f"""w{k + 1} AS MATERIALIZED (SELECT
  CASE WHEN met OR done THEN a ELSE a - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det END AS a,
  CASE WHEN met OR done THEN b ELSE b - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det END AS b,
  CASE WHEN met OR done THEN c ELSE c - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det END AS c,
  met OR done AS done FROM s{k})""")
    values = ", ".join(f"({k}, '{f}')" for k, f in enumerate(EXACT.feature_names))
    out.append(f"""fitted AS (SELECT feature, round(CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 4) AS weight
FROM w{FIT_STEPS}, (VALUES {values}) AS v(k, feature))""")
    names = ["loss", *EXACT.feature_names]
    out.append("fit_log AS (" + " UNION ALL ".join(
        f"SELECT {k} AS step, '{f}' AS name, {c} AS value FROM s{k} WHERE NOT done" for k in range(FIT_STEPS) for f, c in zip(names, ("loss", "a", "b", "c"))) + ")")
    return out


def fitted(t: Tables):
    """The fusion weights learnt from the triplets, rounded to 4 places, and the log of their training."""
    w, log = K.fit_fusion_weights(t.differences, EXACT.feature_names, FIT_REG, FIT_TOL, FIT_STEPS)
    return {f: round(x, 4) for f, x in w.items()}, log


@register("k15_fit_weights", O.with_base(O.EXPANSION, *_fit_sql(), final="SELECT feature, weight FROM fitted"))
def k15_fit_weights(t: Tables):
    """Fusion weights fitted on the triplets (pairwise cross-entropy of feature differences)."""
    return K.weights_frame(t.spark, fitted(t)[0])


@register("m6_training_log", O.with_base(O.EXPANSION, *_fit_sql(), final="""
SELECT CAST(step // 2 AS INTEGER) AS bucket, name, round(avg(value), 4) + 0.0 AS value FROM fit_log GROUP BY step // 2, name"""))
def m6_training_log(t: Tables):
    """M6: loss and weights of K15's descent, averaged over every two steps."""
    history = t.spark.createDataFrame(fitted(t)[1], "step int, name string, value double")
    return M.training_log(history, 2).withColumn("value", F.col("value") + 0.0)


@register("k16_fitted_eval", O.with_base(O.EXPANSION, *_fit_sql(), f"cand AS (SELECT qid, doc_id, rank FROM bm25_run WHERE rank <= {CAND_K})",
                                          *O.sdm_ctes("cand", N_PSG), "fw AS (SELECT feature, weight FROM fitted)",
                                          f"rr AS ({_rerank_sql(EXACT)})", final=O.summary_sql("rr")))
def k16_fitted_eval(t: Tables):
    """K14-K16 with K15's weights: candidates reranked by the learnt fusion, evaluated."""
    cand, pool = pooled(t, EXACT)
    return M.summary(K.rerank(cand, K.fuse(pool, K.weights_frame(t.spark, fitted(t)[0]))), t.qrels)


GRID = [K.SdmConfig(ex, win, prox, n) for ex in (True, False) for win, prox in (((1, 2), 8), ((1, 5), 10))
        for n in range(1, 6)]


@register("k17_grid_eval", None)
def k17_grid_eval(t: Tables):
    """Exact and soft variants x windows {1,2} P 8 / {1,5} P 10 x
    passages 1..5 (20 configurations) reranked and evaluated in one job."""
    cand = _cand(t)
    runs = K.grid_runs(_rows(t, max(c.n_psg for c in GRID), cand), cand, GRID, {c.config_id: K.default_weights(c) for c in GRID})
    return M.summary(runs, t.qrels, group=("config_id",), groups=[c.config_id for c in GRID])


def _grid_sql(configs: list, cand: str = "cand", prefix: str = "s") -> tuple[list[str], str]:
    """CTEs with each shape's passage features, computed once, and the union of the configurations' metrics.  The features
    of a passage number are computed after those of the one before, as all of them at once do not fit in memory."""
    shapes = sorted({K.shape_of(c) for c in configs}, key=lambda x: x.name)
    table = {x: f"{prefix}_f_{x.name.replace('-', '_')}" for x in shapes}
    ctes, before = [], None
    for x in shapes:
        most = max(c.n_psg for c in configs if K.shape_of(c) == x)
        for psg in range(most):
            where = f"psg = {psg}" + (f" AND (SELECT count(*) FROM {before}) >= 0" if before else "")
            before = f"{table[x]}_{psg}"
            ctes.append(f"{before} AS MATERIALIZED ({O.passage_features_sql(prefix, x.exact, x.windows, x.proximity, where)})")
        ctes.append(f"{table[x]} AS ({' UNION ALL '.join(f'SELECT * FROM {table[x]}_{psg}' for psg in range(most))})")
    parts = []
    for c in configs:
        pooled_q = O.pooled_sql(f"SELECT * FROM {table[K.shape_of(c)]} WHERE psg < {c.n_psg}", cand, c.feature_names)
        rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, {O.dbl(w)} AS weight" for f, w in K.default_weights(c).items())
        rr = f"""(SELECT qid, doc_id, round(sum(weight * value), 6) AS score FROM ({pooled_q}) JOIN ({rows}) USING (feature) GROUP BY qid, doc_id)"""
        parts.append(f"SELECT '{c.config_id}' AS config_id, * FROM ({O.summary_sql(rr)}) WHERE n_queries > 0")
    return ctes, " UNION ALL ".join(parts)


from segrank.plans.catalog import REGISTRY  # noqa: E402

COHORT_GRID = {cohort: [K.SdmConfig(True, win, prox, n) for win, prox in (((1, 2), 8), ((1, 5), 10)) for n in range(1, most + 1)]
               for cohort, most in (("short", 2), ("long", 5))}


def k17_cohort_grid(t: Tables):
    """K17 as the evaluation jobs run it: the candidates of short documents with 1-2 passages, those of long ones with 1-5
    (C10's split; queries with a judged document in the cohort), each reranked and evaluated on the cohort's judgements."""
    from segrank.operators import cohorts as C
    short = C.short_docs(t.doc_lengths)
    tagged = C.tag_run(_cand(t), t.qrels, short)
    parts = []
    for cohort, configs in COHORT_GRID.items():
        cand = tagged.where(F.col("cohort") == cohort)
        runs = K.grid_runs(_rows(t, max(c.n_psg for c in configs), cand), cand, configs, {c.config_id: K.default_weights(c) for c in configs})
        judged = C.split_by_docs(t.qrels, short, cohort)
        parts.append(M.summary(runs, judged, group=("config_id",), groups=[c.config_id for c in configs]).withColumn("cohort", F.lit(cohort)))
    return parts[0].unionByName(parts[1])


def _cohort_grid_sql() -> str:
    ctes, finals = list(CAND), []
    ctes += ["doc_len AS (SELECT doc_id, max(psg) + 1 AS n_psg FROM passages GROUP BY doc_id)", "short AS (SELECT doc_id FROM doc_len WHERE n_psg < 3)"]
    for cohort, configs in COHORT_GRID.items():
        inside = "IN" if cohort == "short" else "NOT IN"
        ctes.append(f"qrels_{cohort} AS (SELECT * FROM qrels WHERE doc_id {inside} (SELECT doc_id FROM short))")
        ctes.append(f"""cand_{cohort} AS (SELECT * FROM cand WHERE doc_id {inside} (SELECT doc_id FROM short)
  AND qid IN (SELECT qid FROM qrels_{cohort}))""")
        ctes += O.sdm_ctes(f"cand_{cohort}", max(c.n_psg for c in configs), cohort[0])
        more, final = _grid_sql(configs, f"cand_{cohort}", cohort[0])
        ctes += more
        finals.append(f"SELECT '{cohort}' AS cohort, * FROM ({final.replace('FROM qrels ', f'FROM qrels_{cohort} ')})")
    return O.with_base(O.EXPANSION, *ctes, final=" UNION ALL ".join(finals))


_ctes, _final = _grid_sql(GRID)
REGISTRY["k17_grid_eval"] = (REGISTRY["k17_grid_eval"][0], O.with_base(O.EXPANSION, *CAND, *O.sdm_ctes("cand", 5), *_ctes, final=_final))
register("k17_cohort_grid", _cohort_grid_sql())(k17_cohort_grid)
