"""Registered queries: connectors on the pipeline's own data (S*).

Each query writes a derived table with a sink and reads it back with the
matching source, under the shared checkpoint folder, so the round trip
is checked against the SQL statement of the original table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from segrank.operators import aggregate as A
from segrank.plans import oracle as O
from segrank.plans.catalog import FLAGSHIP_N, flagship_run, register
from segrank.plans.derived import Tables
from segrank.plans.queries_retrieval import BM25, DOT_RUN, bm25_run
from segrank.session import scratch
from segrank.sources import io


def _scratch(t: Tables, name: str) -> str:
    return scratch(t.spark, name)


@register("s10_s3_trec_roundtrip", O.with_base(*BM25, final="SELECT qid, doc_id, rank, score, 'segrank' AS tag FROM bm25_run"))
def s10_s3_trec_roundtrip(t: Tables):
    """S10 -> S3: BM25 run written as TREC text and read back."""
    p = _scratch(t, "trec")
    io.write_trec_run(bm25_run(t), p)
    return io.read_trec_run(t.spark, p)[0]


@register("s9_s2_passages_roundtrip", O.with_base(final="SELECT doc_id, psg, text FROM passages"))
def s9_s2_passages_roundtrip(t: Tables):
    """S9 -> S2: passages as ``doc@@psg \\t text`` lines, id split at ingest."""
    p = _scratch(t, "psg")
    io.write_tsv(t.passages.select(F.concat_ws("@@", "doc_id", F.col("psg").cast("string")).alias("id"), "text"),
                 p, ["id", "text"])
    return io.read_passages_tsv(t.spark, p)[0]


@register("s11_s5_vectors_roundtrip", O.with_base(f"dv AS ({O.doc_agg_sql('max', None)})",
                                                   final="SELECT doc_id, term, CAST(w AS INTEGER) AS w FROM dv"))
def s11_s5_vectors_roundtrip(t: Tables):
    """S11 -> S5: document vectors as JSONL ``{"id", "vector"}`` and back."""
    dv = A.aggregate_passages(t.impacts, "max", None).withColumn("w", F.col("w").cast("int"))
    p = _scratch(t, "vec")
    io.write_vectors_jsonl(dv, p)
    rows, _ = io.read_vectors_jsonl(t.spark, p)
    return rows.select(F.col("id").alias("doc_id"), F.explode("vector").alias("term", "w"))


@register("s13_s8_json_run_roundtrip", O.with_base(*DOT_RUN, final="SELECT qid, doc_id, score FROM run"))
def s13_s8_json_run_roundtrip(t: Tables):
    """S13 -> S8: JSON run ``{qid: {doc: score}}`` and back."""
    p = _scratch(t, "jrun")
    io.write_json_run(flagship_run(t), p)
    return io.read_json_run(t.spark, p)[0]


@register("s12_query_lines", O.with_base(final="""
SELECT qid, string_agg(array_to_string(list_transform(range(qw), lambda x: term), ' '), ' ' ORDER BY term) AS terms
FROM query_impacts WHERE qw > 0 GROUP BY qid"""))
def s12_query_lines(t: Tables):
    """Query vectors as repeated terms."""
    return io.query_vector_lines(t.query_impacts)


@register("s14_lexical_roundtrip", O.with_base(final=f"SELECT doc_id, text FROM ({O.first_n_docs_sql(3)})"))
def s14_lexical_roundtrip(t: Tables):
    """First-3-passage documents as ``{"id", "contents"}`` JSONL and back."""
    p = _scratch(t, "lex")
    io.write_lexical_jsonl(t.first_n_docs(3), p)
    back = t.spark.read.schema("id string, contents string").json(p)
    return back.select(F.col("id").alias("doc_id"), F.col("contents").alias("text"))


@register("s15_cohort_partitions", O.with_base(final="""
SELECT doc_id, psg, 'short' AS cohort FROM passages WHERE n_psg < 3"""))
def s15_cohort_partitions(t: Tables):
    """Passages written partitioned by cohort; the short cohort is read
    back through partition pruning."""
    p = _scratch(t, "coh")
    routed = t.passages.select("doc_id", "psg", F.when(F.col("n_psg") < 3, "short").otherwise("long").alias("cohort"))
    io.write_by_cohort(routed, p)
    return t.spark.read.parquet(p).filter(F.col("cohort") == "short").select("doc_id", "psg", "cohort")


@register("s15_run_partitions", O.with_base(*BM25, final="""
SELECT r.qid, r.doc_id, r.rank, 'short' AS cohort, 200 AS k FROM bm25_run r
WHERE rank <= 200 AND doc_id IN (SELECT doc_id FROM passages GROUP BY doc_id HAVING count(*) < 3)"""))
def s15_run_partitions(t: Tables):
    """S15 with its ``k`` level: the BM25 run cut at 200 and at 1000 rows a query, partitioned by cohort and k; one partition is read
    back by pruning."""
    p = _scratch(t, "runs")
    tagged = t.bm25_top.join(t.doc_lengths, "doc_id").select("qid", "doc_id", "rank", F.when(F.col("n_psg") < 3, "short").otherwise("long").alias("cohort"))
    cuts = F.explode(F.filter(F.array(F.lit(200), F.lit(1000)), lambda k: F.col("rank") <= k)).alias("k")
    io.write_by_cohort(tagged.select("*", cuts), p)
    return t.spark.read.parquet(p).where("cohort = 'short' AND k = 200").select("qid", "doc_id", "rank", "cohort", "k")


@register("e17_batch_size", O.with_base(final="""
SELECT count(*) AS n_vectors, max(n) AS max_entries FROM (SELECT doc_id, psg, count(*) AS n FROM impacts GROUP BY doc_id, psg)"""))
def e17_batch_size(t: Tables):
    """Number of vectors and the largest vector size."""
    per = t.impacts.groupBy("doc_id", "psg").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_vectors"), F.max("n").alias("max_entries"))


@register("c14_membership", O.with_base("""doc_len AS (SELECT doc_id, max(psg) + 1 AS n_psg FROM passages GROUP BY doc_id)""", final="""
SELECT doc_id FROM doc_len WHERE n_psg < 3 AND doc_id = (SELECT min(doc_id) FROM qrels)"""))
def c14_membership(t: Tables):
    """C14: is the smallest judged document in the short cohort (0 or 1 row)."""
    from segrank.operators import cohorts as C
    return C.is_member(C.short_docs(t.doc_lengths), t.qrels.agg(F.min("doc_id")).scalar())


def _good_and_bad(t: Tables, name: str, good, bad):
    """A file of ``good`` lines and, after them, ``bad`` ones: its path."""
    p = _scratch(t, name)
    good.select(F.col("value")).unionByName(bad.select(F.col("value"))).write.text(p)
    return p


def _counts(rows, rejected):
    n = rejected.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_rejected", n)


@register("s1_two_field_reader", """
SELECT (SELECT count(*) FROM benchmark) AS n_rows, 2 * (SELECT count(*) FROM benchmark) AS n_rejected""")
def s1_two_field_reader(t: Tables):
    """Every query as a good line, its id with an empty text and its id
    with three fields as bad ones."""
    q = t.queries
    p = _good_and_bad(t, "two", q.select(F.concat_ws("\t", "qid", "text").alias("value")),
                      q.select(F.explode(F.array(F.concat("qid", F.lit("\t")), F.concat("qid", F.lit("\ta\tb")))).alias("value")))
    return _counts(*io.read_two_field_tsv(t.spark, p))


@register("s4_qrels_reader", O.with_base(final="""
SELECT qid, doc_id, rel, (SELECT 2 * count(*) FROM qrels) AS n_rejected FROM qrels"""))
def s4_qrels_reader(t: Tables):
    """Every judgement as a good line, one without a grade and one whose
    grade is no number as bad ones."""
    q = t.qrels
    line = F.concat_ws(" ", "qid", F.lit("0"), "doc_id", "rel")
    p = _good_and_bad(t, "qrels", q.select(line.alias("value")), q.select(F.explode(F.array(
        F.concat_ws(" ", "qid", F.lit("0"), "doc_id"), F.concat(line, F.lit("x")))).alias("value")))
    rows, rejected = io.read_qrels(t.spark, p)
    return rows.withColumn("n_rejected", rejected.agg(F.count(F.lit(1)).alias("n")).scalar())


@register("s6_triplet_reader", O.with_base(final="""
SELECT qid, doc_id AS pos_id, '"' || doc_id AS neg_id, (SELECT count(*) FROM qrels) AS n_rejected FROM qrels"""))
def s6_triplet_reader(t: Tables):
    """A triplet a judgement, with a quote that must stay, and a line of
    two fields."""
    q = t.qrels
    p = _good_and_bad(t, "trip", q.select(F.concat_ws("\t", "qid", "doc_id", F.concat(F.lit('"'), "doc_id")).alias("value")),
                      q.select(F.concat_ws("\t", "qid", "doc_id").alias("value")))
    rows, rejected = io.read_triplets(t.spark, p)
    return rows.withColumn("n_rejected", rejected.agg(F.count(F.lit(1)).alias("n")).scalar())


@register("s7_text_triplet_reader", O.with_base(final="""
SELECT text AS query, '"' || text AS pos, text AS neg, (SELECT count(*) FROM queries) AS n_rejected FROM queries"""))
def s7_text_triplet_reader(t: Tables):
    """Texts of the queries as good lines, lines of four fields as bad ones."""
    q = t.queries
    p = _good_and_bad(t, "texts", q.select(F.concat_ws("\t", "text", F.concat(F.lit('"'), "text"), "text").alias("value")),
                      q.select(F.concat_ws("\t", "text", "text", "text", "text").alias("value")))
    rows, rejected = io.read_text_triplets(t.spark, p)
    return rows.withColumn("n_rejected", rejected.agg(F.count(F.lit(1)).alias("n")).scalar())
