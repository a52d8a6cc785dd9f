"""Sentence splitting, passage packing, tokenisation.

Passages are built inside each document row with SQL higher-order
functions, so splitting needs no shuffle: a document and its passages
always live in the same task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segrank.functions.text import normalise, sentences, tokens

DEFAULT_BUDGET = 400


def _pack_starts(counts: Column, budget: int) -> Column:
    """Greedy packing (T4): 0-based index of the first sentence of every
    passage.  A sentence opens a new passage when the running token count
    plus its own would exceed ``budget``; the first sentence always opens
    passage 0 (an oversize sentence becomes one oversize passage)."""
    zero = F.struct(
        F.lit(0).alias("n"),
        F.lit(0).alias("k"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc, c):
        new = (acc["k"] == 0) | (acc["n"] + c > F.lit(budget))
        return F.when(
            new,
            F.struct(c.alias("n"), (acc["k"] + 1).alias("k"),
                     F.concat(acc["starts"], F.array(acc["k"])).alias("starts")),
        ).otherwise(
            F.struct((acc["n"] + c).alias("n"), (acc["k"] + 1).alias("k"),
                     acc["starts"].alias("starts")))

    return F.aggregate(counts, zero, step, lambda acc: acc["starts"])


def doc_passages(corpus: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Nested form ``(doc_id, psgs ARRAY<STRUCT<psg, text, n_tok, n_psg>>)``.

    Each step is its own projection so that the sentence array, the token
    counts and the packing fold are computed once per document (the
    optimizer does not merge projections that would duplicate them).
    """
    sents = corpus.select("doc_id", sentences(F.col("text")).alias("sents"))
    counts = sents.withColumn("cnt", F.transform("sents", lambda s: F.size(tokens(s))))
    packed = counts.withColumn("starts", _pack_starts(F.col("cnt"), budget))
    n_sent = F.size("sents")
    starts, cnt, sent = F.col("starts"), F.col("cnt"), F.col("sents")

    n_psg = F.size(starts)

    def one(p):
        lo = F.get(starts, p)
        hi = F.coalesce(F.get(starts, p + 1), n_sent)
        return F.struct(
            p.cast("int").alias("psg"),
            F.array_join(F.slice(sent, lo + 1, hi - lo), " ").alias("text"),
            F.aggregate(F.slice(cnt, lo + 1, hi - lo), F.lit(0), lambda a, b: a + b).alias("n_tok"),
            # carried inside the element: a filter on it then stays above the
            # generator instead of being pushed into the packing expression
            n_psg.cast("int").alias("n_psg"),
        )

    psgs = F.when(n_sent > 0, F.transform(F.sequence(F.lit(0), n_psg - 1), one)) \
        .otherwise(F.array().cast("array<struct<psg:int,text:string,n_tok:int,n_psg:int>>"))
    return packed.select("doc_id", psgs.alias("psgs"))


def split_passages(corpus: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """``passages(doc_id, psg, text, n_tok, n_psg)``; documents without
    any sentence yield no passage."""
    # inline_outer + null filter: a plain inline makes the optimizer infer a
    # ``size(psgs) > 0`` filter and push it below the projections, which
    # re-evaluates the whole packing fold inside that filter.
    return (doc_passages(corpus, budget).select("doc_id", F.inline_outer("psgs"))
            .filter(F.col("psg").isNotNull()))


def tokenize(passages: DataFrame) -> DataFrame:
    """``tokens(doc_id, psg, pos, term)``, positions 0-based within the passage."""
    return (passages.select("doc_id", "psg", F.posexplode_outer(tokens(F.col("text"))).alias("pos", "term"))
            .filter(F.col("term").isNotNull()))


BOUNDARIES = ("[CLS]", "[SEP]")


def with_boundary_slots(passage_terms: DataFrame) -> DataFrame:
    """T3 with the mask of E9: ``(doc_id, psg, pos, term, special)`` from ``(doc_id, psg, terms)``.  The first and the last slot of a
    passage are special tokens, so token i stands at slot i + 1 and a passage of n tokens has n + 2 slots: the boundary
    slots of K4-K11."""
    slot = lambda term, special: F.struct(term.alias("term"), F.lit(special).alias("special"))
    slots = F.concat(F.array(slot(F.lit(BOUNDARIES[0]), True)), F.transform("terms", lambda t: slot(t, False)),
                     F.array(slot(F.lit(BOUNDARIES[1]), True)))
    return passage_terms.select("doc_id", "psg", F.posexplode(slots).alias("pos", "s")).select("doc_id", "psg", "pos", "s.term", "s.special")


def normalise_collection(corpus: DataFrame, sep: str = "") -> DataFrame:
    """Newline / tab to space (optional title+body concat with ``sep``)."""
    extra = [F.col("title")] if "title" in corpus.columns else None
    if extra:
        return corpus.select("doc_id", normalise(F.col("title"), [F.col("text")], sep).alias("text"))
    return corpus.select("doc_id", normalise(F.col("text")).alias("text"))


def truncate_tokens(passages: DataFrame, max_tokens: int = 398) -> DataFrame:
    """Keep the first ``max_tokens`` real tokens of each passage (the two
    special tokens of the reference are not counted here)."""
    toks = F.slice(tokens(F.col("text")), 1, max_tokens)
    return passages.select("doc_id", "psg", F.array_join(toks, " ").alias("text"),
                           F.size(toks).alias("n_tok"))


def _psg_order(legacy_order: bool) -> Column:
    # Q4: the reference sorts passage ids as strings ("10" < "2"); integer
    # order is the default, the string order is kept for parity runs.
    return F.col("psg").cast("string") if legacy_order else F.col("psg")


def first_k_passages(passages: DataFrame, k: int, legacy_order: bool = False) -> DataFrame:
    """First ``k`` passages of every document (top-k per group -> the
    plan gets a partial WindowGroupLimit before the shuffle)."""
    w = Window.partitionBy("doc_id").orderBy(_psg_order(legacy_order))
    return passages.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def first_k_text(passages: DataFrame, k: int) -> DataFrame:
    """Text of the first ``k`` passages joined by a space, one row per document."""
    kept = passages.filter(F.col("psg") < k)
    return kept.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("psg", "text"))),
                                 lambda x: x["text"]), " ").alias("text"))


def first_k_text_nested(doc_psgs: DataFrame, k: int) -> DataFrame:
    """T7 on the nested form: no shuffle at all."""
    return doc_psgs.select(
        "doc_id",
        F.array_join(F.transform(F.slice("psgs", 1, k), lambda x: x["text"]), " ").alias("text"))


def reindex_passages(passages: DataFrame, legacy_order: bool = False) -> DataFrame:
    """Renumber passages densely 0..n-1 within each document."""
    w = Window.partitionBy("doc_id").orderBy(_psg_order(legacy_order))
    return passages.withColumn("psg", (F.row_number().over(w) - 1).cast("int"))


def max_passages(passages: DataFrame) -> DataFrame:
    """Largest number of passages in any document (one row)."""
    per_doc = passages.groupBy("doc_id").agg(F.countDistinct("psg").alias("n"))
    return per_doc.agg(F.max("n").cast("bigint").alias("max_passages"))


def line_splits(lines: DataFrame, n_splits: int) -> DataFrame:
    """``(value, offset, split)`` of text lines with their byte offsets (``io.read_lines_with_offsets``): the collection is cut
    into ``n_splits`` pieces of equal bytes, each line going whole to the piece in which it begins.  The pieces depend on the
    bytes alone, neither on partitions nor on a hash, and put together by offset they are the collection again."""
    total = lines.agg(F.coalesce(F.sum("bytes"), F.lit(0))).scalar()
    return lines.select("value", "bytes", "offset", F.expr("offset * %d" % n_splits).alias("_o")).withColumn(
        "split", F.call_function("div", F.col("_o"), total).cast("int")).drop("_o")


def drop_blocked(tokens_df: DataFrame, blocklist: DataFrame, term_col: str = "term") -> DataFrame:
    """Remove tokens on a blocklist (anti join; the list is broadcast if its counted rows are few)."""
    from segrank.plans.util import small
    return tokens_df.join(small(blocklist.select(F.col(blocklist.columns[0]).alias(term_col)).distinct()), on=term_col, how="left_anti")
