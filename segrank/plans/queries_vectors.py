"""Registered queries: vectors and aggregation (E*, A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from segrank.operators import aggregate as A
from segrank.operators import segment
from segrank.plans import oracle as O
from segrank.plans.catalog import register
from segrank.plans.derived import Tables
from segrank.plans.util import small


@register("e2_impacts", O.with_base(final="SELECT doc_id, psg, term, w FROM impacts"))
def e2_impacts(t: Tables):
    """E2/E3 + E10 + E11: passage impacts."""
    return t.impacts.select("doc_id", "psg", "term", "w")


@register("e2_query_impacts", O.with_base(final="SELECT qid, term, qw FROM query_impacts"))
def e2_query_impacts(t: Tables):
    """Query vectors (sum-reduced, quantised)."""
    return t.query_impacts


@register("qrels", O.with_base(final="SELECT qid, doc_id, rel FROM qrels"))
def qrels(t: Tables):
    """Judgements by verbatim containment."""
    return t.qrels


def _agg_query(mode: str, n: int, ident: str):
    @register(ident, O.with_base(final=O.doc_agg_sql(mode, n)))
    def q(t: Tables):
        return A.aggregate_passages(t.impacts, mode, n)
    q.__doc__ = f"A: {mode} aggregation of the first {n} passages."
    return q


for _id, _mode in (("a1", "first"), ("a2", "max"), ("a3", "sum"), ("a4", "mean"), ("a5", "exp"), ("a6", "gmean")):
    _agg_query(_mode, 3, f"{_id}_{_mode}_n3")


from segrank.operators import vectors as V  # noqa: E402
from segrank.plans.oracle import EXPANSION, quant, doc_agg_sql  # noqa: E402

PK = ["doc_id", "psg"]


@register("e1_binary", O.with_base(final=f"SELECT DISTINCT doc_id, psg, term, {quant('0.3')} AS w FROM tokens"))
def e1_binary(t: Tables):
    """Binary bag of words, every token weighs 0.3 (-> 30)."""
    return V.binary_encoder(t.passage_tf, PK, 0.3, already_distinct=True)


@register("e2_scaled_binary", O.with_base(final=f"""
SELECT * FROM (SELECT doc_id, psg, term, {quant('scale')} AS w
FROM (SELECT DISTINCT doc_id, psg, term FROM tokens) JOIN term_weights USING (term)) WHERE w <> 0"""))
def e2_scaled_binary(t: Tables):
    """Binary bag of words with the per-term scale table."""
    return V.scaled_encoder(t.passage_tf, PK, t.term_weights, already_distinct=True)


@register("e3_token_weights", O.with_base(final=f"""
SELECT * FROM (SELECT doc_id, psg, term, {quant('max(ln(1 + greatest(scale, 0.0)))')} AS w
FROM tokens JOIN term_weights USING (term) GROUP BY doc_id, psg, term) WHERE w <> 0"""))
def e3_token_weights(t: Tables):
    """E3 + E6 + E7(max): ``log1p(relu(score))`` per position, max-pooled.  The score depends on the term, so each term of a
    passage is read once, with its df from the posting: no join on a hot term."""
    scores = t.passage_tf.select(*PK, F.lit(0).alias("pos"), "term", t.scale(F.col("df")).alias("s"))
    return V.token_weight_encoder(scores, PK, "log1p_relu", pool="max")


@register("e7_abs_pool", O.with_base(final=f"""
SELECT * FROM (SELECT doc_id, psg, term, {quant('arg_max(v, (abs(v), -pos))')} AS w
FROM (SELECT doc_id, psg, pos, term, CASE WHEN pos % 3 = 1 THEN -scale ELSE scale END AS v FROM tokens JOIN term_weights USING (term))
GROUP BY doc_id, psg, term) WHERE w <> 0"""))
def e7_abs_pool(t: Tables):
    """E7 abs: of signed position weights the one of largest magnitude, the first position winning ties (every third position is
    made negative here)."""
    s = F.when(F.col("pos") % 3 == 1, -F.col("scale")).otherwise(F.col("scale"))
    scores = t.tokens.join(t.term_weights, "term").select(*PK, "pos", "term", s.alias("s"))
    return V.token_weight_encoder(scores, PK, "identity", pool="abs")


@register("e7_sum_pool", O.with_base(final=f"""
SELECT * FROM (SELECT doc_id, psg, term, {quant('sum(ln(1 + greatest(scale, 0.0)))')} AS w
FROM tokens JOIN term_weights USING (term) GROUP BY doc_id, psg, term) WHERE w <> 0"""))
def e7_sum_pool(t: Tables):
    """E3 with sum pooling over positions (E7 sum)."""
    scores = t.tokens.join(t.term_weights, "term").select(*PK, "pos", "term", F.col("scale").alias("s"))
    return V.token_weight_encoder(scores, PK, "log1p_relu", pool="sum")


# The weights are applied before the product, as in the plan: a maximum has a weight if one of its cells has one.
_E4 = [EXPANSION, f"e4w AS MATERIALIZED (SELECT * FROM (SELECT src_term, term, {quant('ln(1 + greatest(s, 0.0))')} AS w FROM expansion) WHERE w <> 0)",
       "present AS (SELECT DISTINCT doc_id, psg, term FROM tokens)",
       """e4 AS MATERIALIZED (SELECT p.doc_id, p.psg, e.term, max(e.w) AS w FROM present p JOIN e4w e ON e.src_term = p.term
GROUP BY p.doc_id, p.psg, e.term)"""]


def _e4(t: Tables):
    """The columns' index and the expansion vectors over it."""
    index = V.vocabulary_index(t.lexicon)
    return index, V.expansion_vectors(t.passage_terms, PK, t.weighty_expansion, index)


@register("e4_expansion", O.with_base(*_E4, final="""
SELECT doc_id, psg, count(*) AS n_terms, CAST(sum(w) AS BIGINT) AS sum_w, max(w) AS max_w, min(term) AS first_term, max(term) AS last_term
FROM e4 GROUP BY doc_id, psg"""))
def e4_expansion(t: Tables):
    """Expansion vectors (all neighbours of all terms, log1p-relu activation, max over positions), a row a passage."""
    index, vectors = _e4(t)
    # the index is in term order, so the first and the last term are the least and the largest column
    rows = vectors.select(*PK, F.size("idx").cast("bigint").alias("n_terms"), F.aggregate("w", F.lit(0).cast("bigint"), lambda a, w: a + w).alias("sum_w"),
                          F.array_max("w").alias("max_w"), F.array_min("idx").alias("first"), F.array_max("idx").alias("last"))
    for name in ("first", "last"):
        rows = rows.join(index.select(F.col("idx").alias(name), F.col("term").alias(f"{name}_term")), name)
    return rows.select(*PK, "n_terms", "sum_w", "max_w", "first_term", "last_term")


@register("e4_expansion_whole", O.with_base(*_E4, final="""
SELECT term, count(*) AS n_passages, CAST(sum(w) AS BIGINT) AS sum_w, max(w) AS max_w, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM e4 GROUP BY term"""))
def e4_expansion_whole(t: Tables):
    """E4, the same vectors by column: a row a term."""
    index, vectors = _e4(t)
    columns = V.column_totals(vectors).join(index, "idx")
    return columns.select("term", F.col("n").alias("n_passages"), "sum_w", "max_w", F.col("first").alias("first_doc"), F.col("last").alias("last_doc"))


@register("e8_gated_expansion", O.with_base(*_E4, final="SELECT doc_id, psg, term, w FROM e4 JOIN present USING (doc_id, psg, term)"))
def e8_gated_expansion(t: Tables):
    """Expansion vector gated to the terms present in the passage."""
    return V.gated_expansion(t.passage_terms, PK, t.weighty_expansion)


_EPIC = "ln(1 + (greatest(scale, 0.0) + ln(1 + exp(-abs(scale)))))"


@register("e5_epic", O.with_base(final=f"""
SELECT * FROM (SELECT doc_id, psg, term,
  {quant(f'max({_EPIC})')} AS w
FROM tokens JOIN term_weights USING (term) GROUP BY doc_id, psg, term) WHERE w <> 0"""))
def e5_epic(t: Tables):
    """E5: term importance ``log1p(softplus(score))``."""
    return V.epic_encoder(t.passage_tf.select(*PK, "term", t.scale(F.col("df")).alias("s")), PK)


@register("e5_epic_importance", O.with_base(final=f"""
SELECT * FROM (SELECT doc_id, psg, term,
  {quant(f'max({_EPIC} * (1.0::DOUBLE / (1.0::DOUBLE + exp(-(CAST(n_tok AS DOUBLE) / 30.0 - 1.0)))))')} AS w
FROM tokens JOIN term_weights USING (term) GROUP BY doc_id, psg, term) WHERE w <> 0"""))
def e5_epic_importance(t: Tables):
    """E5 with document importance: the same times ``sigmoid(x)`` of a passage score x (here of its length)."""
    size = t.passage_terms.select(*PK, F.size("terms").alias("n_tok"))
    scores = t.passage_tf.join(size, PK).select(*PK, "term", "n_tok", t.scale(F.col("df")).alias("s"))
    return V.epic_encoder(scores, PK, F.col("n_tok").cast("double") / F.lit(30.0) - F.lit(1.0))


# Slots with special tokens at both ends of a passage
_SLOTS = """slots AS (SELECT doc_id, psg, pos + 1 AS pos, term, false AS special FROM tokens
  UNION ALL SELECT doc_id, psg, 0, '[CLS]', true FROM passages WHERE n_tok >= 0 UNION ALL SELECT doc_id, psg, n_tok + 1, '[SEP]', true FROM passages)"""


@register("e9_masked_slots", O.with_base(_SLOTS, final=f"""
SELECT doc_id, psg, CAST(pos AS INTEGER) AS pos, term, special, CASE WHEN special THEN 0 ELSE {quant('0.3')} END AS w FROM slots"""))
def e9_masked_slots(t: Tables):
    """Every slot of every passage, boundary tokens too, with its E1 weight: a special token holds a slot but no weight."""
    from segrank.functions.numeric import quantise
    slots = segment.with_boundary_slots(t.passage_terms)
    return slots.withColumn("w", F.when(F.col("special"), 0).otherwise(quantise(F.lit(0.3))))


@register("e9_masked_encoder", O.with_base(_SLOTS, "marked_weights AS (SELECT * FROM term_weights UNION ALL SELECT '[CLS]', 9.0 UNION ALL SELECT '[SEP]', 9.0)",
                                           final=f"""
SELECT * FROM (SELECT doc_id, psg, term, {quant('max(ln(1 + greatest(scale, 0.0)))')} AS w
FROM slots JOIN marked_weights USING (term) WHERE NOT special GROUP BY doc_id, psg, term) WHERE w <> 0"""))
def e9_masked_encoder(t: Tables):
    """E9 + E3: the token-weight encoder over marked slots; the boundary tokens have a learned score here, and no weight."""
    marked = t.spark.createDataFrame([(b, 9.0) for b in segment.BOUNDARIES], "term string, scale double")
    scores = segment.with_boundary_slots(t.passage_terms).join(t.term_weights.unionByName(marked), "term").withColumnRenamed("scale", "s")
    return V.token_weight_encoder(scores, PK, "log1p_relu", pool="max")


@register("e13_avg_nnz", O.with_base(final="""
SELECT round(avg(coalesce(nnz, 0)), 6) AS avg_nnz, count(*) AS n_vectors
FROM (SELECT doc_id, psg FROM passages) p
LEFT JOIN (SELECT doc_id, psg, count(*) AS nnz FROM impacts WHERE w > 0 GROUP BY doc_id, psg) i USING (doc_id, psg)"""))
def e13_avg_nnz(t: Tables):
    """Mean number of positive entries per passage vector."""
    ids = t.passages.select(F.concat_ws("@@", "doc_id", F.col("psg").cast("string")).alias("id"))
    vec = t.impacts.select(F.concat_ws("@@", "doc_id", F.col("psg").cast("string")).alias("id"), "term", "w")
    return V.avg_positive_entries(vec, ids, "id").select(F.round("avg_nnz", 6).alias("avg_nnz"), "n_vectors")


_E14 = """
SELECT p.qid, p.doc_id, CAST(coalesce(d.dot, 0) AS BIGINT) AS dot
FROM (SELECT DISTINCT qid, doc_id FROM qrels) p
LEFT JOIN (SELECT q.qid, v.doc_id, sum(q.qw * v.w) AS dot FROM {first} q JOIN dv v USING (term)
           WHERE (q.qid, v.doc_id) IN (SELECT qid, doc_id FROM qrels) GROUP BY q.qid, v.doc_id) d
  ON d.qid = p.qid AND d.doc_id = p.doc_id"""
# an entry for each position of a query: equal terms are separate entries
_ENTRIES = f"entries AS (SELECT * FROM (SELECT qid, term, {quant('scale')} AS qw FROM query_tokens JOIN term_weights USING (term)) WHERE qw <> 0)"


def _query_entries(t: Tables):
    from segrank.functions.numeric import quantise
    return t.query_tokens.join(t.term_weights, "term").select("qid", "term", quantise(F.col("scale")).alias("qw")).where("qw <> 0")


def _judged_vectors(t: Tables):
    """Passage entries of the judged documents only."""
    return t.impacts.join(small(t.qrels.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "term", "w")


@register("e14_rowwise_dot", O.with_base(f"dv AS ({doc_agg_sql('max', None)})", final=_E14.format(first="query_impacts")))
def e14_rowwise_dot(t: Tables):
    """Query . document for every judged (query, document) pair."""
    return V.rowwise_dot(t.query_impacts, _judged_vectors(t), t.qrels)


@register("e14_sparse_sparse", O.with_base(f"dv AS ({doc_agg_sql('max', None)})", _ENTRIES, final=_E14.format(first="entries")))
def e14_sparse_sparse(t: Tables):
    """One entry a query position, one a passage term: the largest product with an equal entry counts for each."""
    return V.rowwise_dot(_query_entries(t), _judged_vectors(t), t.qrels)


def _query_columns(t: Tables):
    """The query terms' column numbers, and how many there are."""
    index = t.store.table("query_columns", ["documents", "benchmark"], lambda: V.vocabulary_index(t.query_tokens.select("term").distinct()))
    return index, index.count()


def _dense_documents(t: Tables, index, size: int):
    return V.to_dense(V.reduce_duplicates(_judged_vectors(t), ["doc_id"], "amax"), "doc_id", index, size)


@register("e14_sparse_dense", O.with_base(f"dv AS ({doc_agg_sql('max', None)})", _ENTRIES, final=_E14.format(first="entries")))
def e14_sparse_dense(t: Tables):
    """Query entries pick the columns of dense document rows (duplicates reduced by maximum, E11)."""
    index, size = _query_columns(t)
    return V.sparse_dense_dot(_query_entries(t), _dense_documents(t, index, size), t.qrels, index)


@register("e14_dense_dense", O.with_base(f"dv AS ({doc_agg_sql('max', None)})", _ENTRIES, final=_E14.format(first="entries")))
def e14_dense_dense(t: Tables):
    """Both sides as arrays over the query terms; the queries' equal entries are summed."""
    index, size = _query_columns(t)
    queries = V.to_dense(V.reduce_duplicates(_query_entries(t), ["qid"], "sum", "qw"), "qid", index, size, "qw")
    return V.dense_dot(queries, _dense_documents(t, index, size), t.qrels)


@register("e11_amax", O.with_base(final="SELECT doc_id, term, CAST(greatest(max(w), 0) AS INTEGER) AS w FROM impacts GROUP BY doc_id, term"))
def e11_amax(t: Tables):
    """E11 amax: equal terms of a document's passages reduced to the largest weight, never below 0."""
    return V.reduce_duplicates(t.impacts, ["doc_id"], "amax")


@register("e15_all_pairs_dot", O.with_base(f"dv AS ({doc_agg_sql('max', None)})", final="""
SELECT qid, doc_id, CAST(sum(qw * w) AS BIGINT) AS dot FROM query_impacts JOIN dv USING (term) GROUP BY qid, doc_id"""))
def e15_all_pairs_dot(t: Tables):
    """Every query against every document sharing a term; entries of other terms are left out before they are reduced."""
    asked = t.impacts.join(small(t.query_impacts.select("term").distinct()), "term", "left_semi")
    return V.all_pairs_dot(t.query_impacts, A.aggregate_passages(asked, "max", None))


@register("e15_top_dots", O.with_base(f"dv AS ({doc_agg_sql('max', None)})", final="""
SELECT qid, doc_id, dot, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dot DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT qid, doc_id, CAST(sum(qw * w) AS DOUBLE) AS dot FROM query_impacts JOIN dv USING (term) GROUP BY qid, doc_id)) WHERE rank <= 100"""))
def e15_top_dots(t: Tables):
    """E15 in blocks: the 100 largest dot products of every query, kept while blocks of documents stream by."""
    docs = t.impacts.groupBy("term", "doc_id").agg(F.max("w").alias("w"))
    return V.block_top_dots(t.query_impacts, docs, 100)


@register("e16_repeat", O.with_base(final="""
SELECT qid, term, qw, CAST(r AS INTEGER) AS rep FROM query_impacts, range(1, 3) AS g(r)"""))
def e16_repeat(t: Tables):
    """Every query-vector row twice."""
    return V.repeat_rows(t.query_impacts, 2).withColumn("rep", F.col("rep").cast("int"))


@register("e18_vocabulary", O.with_base(final="SELECT DISTINCT term FROM impacts"))
def e18_vocabulary(t: Tables):
    """Global vocabulary of the passage vectors."""
    return V.vocabulary(t.impacts)


@register("e19_vocab_index", O.with_base(final="""
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT term FROM impacts)"""))
def e19_vocab_index(t: Tables):
    """Term -> column number in term order (distributed index)."""
    return V.vocabulary_index(V.vocabulary(t.impacts))


@register("e20_query_tf", O.with_base(final="""
SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(string_split(text, ' ')) AS term FROM queries)
WHERE length(term) > 0 AND term IN (SELECT term FROM impacts) GROUP BY qid, term"""))
def e20_query_tf(t: Tables):
    """Query term frequencies restricted to the vocabulary."""
    return V.query_tf_in_vocab(t.queries, V.vocabulary(t.impacts))


@register("a7_sweep_summary", O.with_base("""sw AS (
  SELECT n, doc_id, term, greatest(max(CAST(w AS DOUBLE)), 0.0) AS mx, sum(CAST(w AS DOUBLE)) AS sm, any_value(n_psg) AS np
  FROM impacts, range(1, 11) AS g(n) WHERE psg < n GROUP BY n, doc_id, term)""", """st AS (
  SELECT 'max' AS mode, n, doc_id, mx AS w FROM sw
  UNION ALL SELECT 'sum', n, doc_id, sm FROM sw
  UNION ALL SELECT 'mean', n, doc_id, sm / least(n, np) FROM sw)""", final="""
SELECT mode, CAST(n AS INTEGER) AS n, count(DISTINCT doc_id) AS n_docs, count(*) AS n_entries,
       round(sum(w), 2) AS total_w
FROM st GROUP BY mode, n"""))
def a7_sweep_summary(t: Tables):
    """Max / sum / mean over the first n = 1..10 passages in one pass,
    summarised per (mode, n)."""
    # dealt by document: neither the sweep nor the count of its documents exchanges anything more
    sw = A.aggregate_sweep(t.impacts.repartition("doc_id"), 10)
    per = sw.groupBy("mode", "n", "doc_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("w").alias("w"))
    return per.groupBy("mode", "n").agg(F.count("doc_id").alias("n_docs"), F.sum("entries").alias("n_entries"), F.round(F.sum("w"), 2).alias("total_w"))
