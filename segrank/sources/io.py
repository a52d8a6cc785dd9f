"""File sources and sinks of the pipeline.

All readers use fixed schemas (no inference) and keep bad lines out of
the data while exposing how many were rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segrank.functions.text import PSG_SEP

VECTOR_SCHEMA = "id string, text string, vector map<string,int>"
JSON_RUN_SCHEMA = "map<string, map<string, double>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, line_at)``: lines with their place in file order (path, block
    offset, row in the block), used where "the last line wins"."""
    return spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")).alias("line_at"))


def _fields(spark: SparkSession, path: str, sep: str, n: int) -> DataFrame:
    """Lines stripped of blanks, tabs and line ends at both sides, split at
    ``sep``; ``ok``: exactly ``n`` fields.  Nothing else is interpreted, quotes
    least of all."""
    lines = _lines(spark, path).withColumn("p", F.split(F.trim(F.col("value"), F.lit(" \t\r\n")), sep, -1))
    return lines.withColumn("ok", F.size("p") == n)


def _parted(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``ok`` holds, and the lines of all others."""
    df = df.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return df.filter("ok"), df.filter(~F.col("ok")).select("value")


def _passage_id(c: Column, sep: str) -> tuple[Column, Column]:
    """Document and passage number (null if it is none) of an id; ``sep`` is
    taken literally and its last occurrence counts."""
    n = F.split_part(c, F.lit(sep), F.lit(-1))
    doc = F.substring(c, F.lit(1), F.length(c) - F.length(n) - len(sep))
    number = F.when(n.rlike("^[0-9]+$") & (F.length(doc) > 0), n.try_cast("int"))
    return doc, number


def read_two_field_tsv(spark: SparkSession, path: str, names=("id", "text")) -> tuple[DataFrame, DataFrame]:
    """``id \\t text`` lines; exactly two fields after stripping the line
    (others are rejected).  Returns ``(rows, rejected)``."""
    rows, rejected = _parted(_fields(spark, path, "\t", 2), F.col("ok"))
    return rows.select(F.get("p", F.lit(0)).alias(names[0]), F.get("p", F.lit(1)).alias(names[1])), rejected


def read_passages_tsv(spark: SparkSession, path: str, sep: str = PSG_SEP) -> tuple[DataFrame, DataFrame]:
    """``doc<sep>psg \\t text``; the id is split at ingest (psg INT).  A
    duplicated passage id keeps its last line in file order (Q1).  Returns
    ``(rows, rejected)``."""
    doc, psg = _passage_id(F.get("p", F.lit(0)), sep)
    x = _fields(spark, path, "\t", 2).select("value", "line_at", "ok", F.get("p", F.lit(1)).alias("text"),
                                             doc.alias("doc_id"), psg.alias("psg"))
    rows, rejected = _parted(x, F.col("ok") & F.col("psg").isNotNull())
    return rows.groupBy("doc_id", "psg").agg(F.max_by("text", "line_at").alias("text")), rejected


def read_trec_run(spark: SparkSession, path: str, psg_sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: six space-separated columns; with ``psg_sep`` the document column
    is split into ``doc_id, psg`` (passage runs).  Returns ``(rows, rejected)``:
    lines with other numbers of columns, or whose rank or score is no number,
    are rejected."""
    f = lambda k: F.get("p", F.lit(k))
    x = _fields(spark, path, " +", 6).select(
        "value", "ok", f(0).alias("qid"), f(2).alias("doc_id"), f(3).try_cast("int").alias("rank"),
        f(4).try_cast("double").alias("score"), f(5).alias("tag"))
    ok, cols = F.col("ok") & F.col("rank").isNotNull() & F.col("score").isNotNull(), ["qid", "doc_id"]
    if psg_sep:
        doc, psg = _passage_id(F.col("doc_id"), psg_sep)
        x = x.withColumn("psg", psg).withColumn("doc_id", F.when(F.col("psg").isNotNull(), doc))
        ok, cols = ok & F.col("psg").isNotNull(), ["qid", "doc_id", "psg"]
    rows, rejected = _parted(x, ok)
    return rows.select(*cols, "rank", "score", "tag"), rejected


def read_qrels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``qid iter doc_id rel``.  Returns ``(rows, rejected)``."""
    x = _fields(spark, path, "[ \t]+", 4).select("value", "ok", F.get("p", F.lit(0)).alias("qid"), F.get("p", F.lit(2)).alias("doc_id"),
                                                F.get("p", F.lit(3)).try_cast("int").alias("rel"))
    rows, rejected = _parted(x, F.col("ok") & F.col("rel").isNotNull())
    return rows.select("qid", "doc_id", "rel"), rejected


def read_vectors_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSONL ``{"id", "text", "vector": {term: int}}``; unparsable lines
    are rejected.  Returns ``(rows, rejected)``."""
    raw = spark.read.text(path)
    parsed = raw.select("value", F.from_json("value", VECTOR_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"))
    ok = F.col("j").isNotNull() & F.col("j.id").isNotNull() & F.col("j.vector").isNotNull()
    return parsed.filter(ok).select("j.*"), parsed.filter(~ok).select("value")


def _three(spark: SparkSession, path: str, names: tuple[str, str, str]) -> tuple[DataFrame, DataFrame]:
    rows, rejected = _parted(_fields(spark, path, "\t", 3), F.col("ok"))
    return rows.select(*(F.get("p", F.lit(k)).alias(c) for k, c in enumerate(names))), rejected


def read_triplets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S6 (reader part): ``qid \\t pos_id \\t neg_id``; existence filtering is
    ``sdm.clean_triplets``.  Returns ``(rows, rejected)``."""
    return _three(spark, path, ("qid", "pos_id", "neg_id"))


def read_text_triplets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``query \\t pos \\t neg`` texts.  Returns ``(rows, rejected)``."""
    return _three(spark, path, ("query", "pos", "neg"))


def read_json_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``{qid: {doc_id: score}}`` - one object per file or one per line.
    Returns ``(rows, rejected)``; blank lines are neither."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    x = raw.select("value", F.from_json("value", JSON_RUN_SCHEMA).alias("m"))
    rows, rejected = _parted(x, F.col("m").isNotNull())
    rows = rows.select(F.explode("m").alias("qid", "docs"))
    return rows.select("qid", F.explode("docs").alias("doc_id", "score")), rejected


# ------------------------------------------------------------------ sinks

def write_tsv(df: DataFrame, path: str, cols: list[str], mode: str = "overwrite") -> None:
    """Tab-separated text, one line per row (newlines/tabs in the text
    columns normalised first)."""
    clean = [F.translate(F.col(c).cast("string"), "\n\t", "  ") for c in cols]
    df.select(F.concat_ws("\t", *clean).alias("value")).write.mode(mode).text(path)


def write_trec_run(run: DataFrame, path: str, tag: str = "segrank", psg_sep: str | None = None,
                   mode: str = "overwrite") -> None:
    """``qid Q0 doc rank score tag``, sorted by query then rank within
    each output partition."""
    doc = F.concat_ws(psg_sep, "doc_id", F.col("psg").cast("string")) if psg_sep else F.col("doc_id")
    out = run.repartition("qid").sortWithinPartitions("qid", "rank").select(F.concat_ws(
        " ", "qid", F.lit("Q0"), doc, F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag)).alias("value"))
    out.write.mode(mode).text(path)


def write_vectors_jsonl(vec: DataFrame, path: str, key: str = "doc_id", wcol: str = "w",
                        mode: str = "overwrite") -> None:
    """One JSON object per line ``{"id", "vector"}`` (fixes Q2)."""
    grouped = vec.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", wcol)))).alias("vector"))
    grouped.select(F.to_json(F.struct(F.col(key).alias("id"), "vector")).alias("value")).write.mode(mode).text(path)


def query_vector_lines(qvec: DataFrame) -> DataFrame:
    """``qid \\t term term ...`` with every term repeated ``qw`` times;
    empty vectors dropped (weights <= 0 vanish)."""
    rep = qvec.filter(F.col("qw") > 0).select("qid", F.array_repeat("term", F.col("qw")).alias("r"), "term")
    lines = rep.groupBy("qid").agg(F.array_join(F.flatten(F.array_sort(F.collect_list(F.struct("term", "r"))).getField("r")), " ").alias("terms"))
    return lines.filter(F.length("terms") > 0)


def write_query_vectors(qvec: DataFrame, path: str, mode: str = "overwrite") -> None:
    query_vector_lines(qvec).select(F.concat_ws("\t", "qid", "terms").alias("value")).write.mode(mode).text(path)


def json_run_lines(run: DataFrame) -> DataFrame:
    """``{qid: {doc_id: score}}``, one object per query and line (a
    whole run is never funnelled into one row)."""
    per_q = run.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "score"))).alias("docs"))
    return per_q.select(F.to_json(F.create_map("qid", "docs")).alias("value"))


def write_json_run(run: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_run_lines(run).write.mode(mode).text(path)


def write_lexical_jsonl(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``{"id", "contents"}`` per line for lexical indexing."""
    docs.select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("contents"))).alias("value")) \
        .write.mode(mode).text(path)


def write_by_cohort(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table partitioned by ``cohort`` (and ``k`` when present)
    instead of file-name suffixes; readers prune partitions."""
    parts = ["cohort"] + (["k"] if "k" in df.columns else [])
    df.write.mode(mode).partitionBy(*parts).parquet(path)


def read_lines_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``(value, bytes, offset)``: lines of the text files under ``path`` with their place in the files laid end to end in the
    order of their names.  A block's lines are whole lines, so the bytes of all blocks before it are the offset of its
    first one, wherever a line crosses the border of two blocks; within a block the offset is a running sum."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", (F.octet_length("value") + 1).cast("long").alias("bytes"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("file", "block").agg(F.sum("bytes").alias("size"))      # one row for each block of a file
    base = blocks.select("file", "block", (F.sum("size").over(Window.orderBy("file", "block")) - F.col("size")).alias("_base"))
    run = F.sum("bytes").over(Window.partitionBy("file", "block").orderBy("_at"))
    return (lines.withColumn("_run", run - F.col("bytes")).join(base, ["file", "block"])
            .select("value", "bytes", (F.col("_base") + F.col("_run")).alias("offset")))
