"""Registered queries: segmentation and text (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from segrank.operators import segment
from segrank.plans import oracle as O
from segrank.plans.catalog import register
from segrank.plans.derived import Tables
from segrank.session import scratch
from segrank.sources import io


@register("t2_passages", O.with_base(final="SELECT doc_id, psg, text, n_tok, n_psg FROM passages"))
def t2_passages(t: Tables):
    """Sentence split and greedy packing into passages."""
    return t.passages


@register("t3_tokens", O.with_base(final="SELECT doc_id, psg, pos, term FROM tokens"))
def t3_tokens(t: Tables):
    """Token positions per passage."""
    return segment.tokenize(t.passages)


@register("t1_normalise", O.with_base(
    final="SELECT doc_id, translate(text, chr(10) || chr(9), '  ') AS text FROM corpus"))
def t1_normalise(t: Tables):
    """Newline and tab replaced by a space."""
    return segment.normalise_collection(t.corpus)


@register("t6_truncate32", O.with_base(final=f"""
SELECT doc_id, psg, array_to_string(tk[1:32], ' ') AS text, CAST(len(tk[1:32]) AS INTEGER) AS n_tok
FROM (SELECT doc_id, psg, regexp_extract_all(lower(text), '{O.TOK_RE}') AS tk FROM passages)"""))
def t6_truncate32(t: Tables):
    """Passages cut to their first 32 tokens."""
    return segment.truncate_tokens(t.passages, 32)


@register("t7_first3_text", O.with_base(final="""
SELECT c.doc_id, coalesce(string_agg(p.text, ' ' ORDER BY p.psg), '') AS text
FROM corpus c LEFT JOIN passages p ON p.doc_id = c.doc_id AND p.psg < 3 GROUP BY c.doc_id"""))
def t7_first3_text(t: Tables):
    """The first 3 passages of each document joined into one text."""
    return t.first_n_docs(3)


@register("t7_first3_text_grouped", O.with_base(final="""
SELECT doc_id, string_agg(text, ' ' ORDER BY psg) AS text FROM passages WHERE psg < 3 GROUP BY doc_id"""))
def t7_first3_text_grouped(t: Tables):
    """T7 on a long passage table (grouped form, for passage files)."""
    return segment.first_k_text(t.passages.select("doc_id", "psg", "text"), 3)


@register("t8_first2", O.with_base(final="SELECT doc_id, psg, text FROM passages WHERE psg < 2"))
def t8_first2(t: Tables):
    """First 2 passages per document (window top-k)."""
    return segment.first_k_passages(t.passages.select("doc_id", "psg", "text"), 2)


@register("t8_first3_legacy", O.with_base(final="""
SELECT doc_id, psg, text FROM (
  SELECT doc_id, psg, text, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(psg AS VARCHAR)) AS rn
  FROM passages) WHERE rn <= 3"""))
def t8_first3_legacy(t: Tables):
    """T8 with the string order of passage ids (Q4 parity): 0, 1, 10, ..."""
    return segment.first_k_passages(t.passages.select("doc_id", "psg", "text"), 3, legacy_order=True)


@register("t9_reindex", O.with_base(final="""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY psg) - 1 AS INTEGER) AS psg, psg AS old_psg
FROM passages"""))
def t9_reindex(t: Tables):
    """Renumber densely (gaps are made in the unit test)."""
    kept = t.passages.select("doc_id", "psg", F.col("psg").alias("old_psg"))
    return segment.reindex_passages(kept)


@register("t10_max_passages", O.with_base(final="""
SELECT CAST(max(n) AS BIGINT) AS max_passages FROM (SELECT doc_id, count(DISTINCT psg) AS n FROM passages GROUP BY doc_id)"""))
def t10_max_passages(t: Tables):
    """Largest number of passages in a document."""
    return segment.max_passages(t.passages)


N_SPLITS = 4


@register("t11_splits", O.with_base(
    "lines AS (SELECT doc_id, octet_length(encode(doc_id || chr(9) || replace(replace(text, chr(10), ' '), chr(9), ' '))) + 1 AS bytes FROM corpus)",
    "placed AS (SELECT doc_id, bytes, sum(bytes) OVER (ORDER BY doc_id) - bytes AS place FROM lines)", final=f"""
SELECT CAST(place * {N_SPLITS} // (SELECT sum(bytes) FROM lines) AS INTEGER) AS split, count(*) AS n_docs, CAST(sum(bytes) AS BIGINT) AS n_bytes,
       min(doc_id) AS first_id, max(doc_id) AS last_id, CAST(min(place) AS BIGINT) AS starts_at FROM placed GROUP BY 1"""))
def t11_splits(t: Tables):
    """The normalised collection, written as text files in the order of the ids and cut into 4 line-complete pieces by byte
    offset."""
    path = scratch(t.spark, "t11")
    rows = segment.normalise_collection(t.corpus).select(F.col("doc_id").alias("id"), "text")
    io.write_tsv(rows.repartitionByRange("id").sortWithinPartitions("id"), path, ["id", "text"])
    lines = io.read_lines_with_offsets(t.spark, path)
    first = F.substring_index("value", "\t", 1)
    return segment.line_splits(lines, N_SPLITS).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("bytes").alias("n_bytes"), F.min(first).alias("first_id"), F.max(first).alias("last_id"),
        F.min("offset").alias("starts_at"))


@register("t12_blocklist", O.with_base(final="""
SELECT doc_id, psg, pos, term FROM tokens
WHERE term NOT IN (SELECT term FROM term_df WHERE 10 * df > (SELECT count(*) FROM corpus))"""))
def t12_blocklist(t: Tables):
    """Tokens minus a blocklist (here the terms found in more than
    10% of the documents)."""
    # fewer than 10 x (mean distinct terms per document) terms can have
    # df > N/10 (the df values sum to that total), so the list is bounded
    bl = t.term_df.filter(F.col("df") * 10 > t.n_docs.select("n_docs").scalar()).select("term")
    return segment.drop_blocked(t.tokens.select("doc_id", "psg", "pos", "term"), bl)
