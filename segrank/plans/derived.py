"""Logical tables of the pipeline derived from the driver tables.

| table          | derivation |
|----------------|------------|
| corpus         | documents(doc_id, text) |
| passages       | sentence split + greedy packing with a token budget |
| tokens         | positions of lower-cased word tokens per passage |
| queries        | benchmark(item_id, text): all tokens |
| qrels          | benchmark text contained verbatim in a document; grade 1 + labels.quality |
| term_weights   | ln(1 + N/df) over documents |
| impacts        | passage vectors: tf-idf token scores, max-pooled, quantised |
| query_impacts  | query vectors: term scale x count, quantised |

``forward``, ``lengths``, ``lexicon``, ``postings``, ``expansion``, ``weighty_expansion`` and ``bm25_top`` are stored (``sources.store``): the first query that needs
one writes it, all others read it.  The rest is lazy; each property builds its plan once per instance.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrank.functions.numeric import quantise
from segrank.functions.text import tokens as tokens_of
from segrank.operators import postings, sdm, segment, vectors
from segrank.operators.retrieve import Collection, bm25
from segrank.operators.topk import query_blocks
from segrank.plans.util import small
from segrank.sources import testdata
from segrank.sources.store import Store

# fixed values of the fixture mapping
PASSAGE_BUDGET = 60   # tokens per passage on the small fixtures (400 in production)
SHORT_ITEMS = 500     # items without interior words that are searched in one pass over the documents
GRAM = 4              # interior words of an item by which documents become candidates for containment


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, budget: int = PASSAGE_BUDGET, slice_rows: int = postings.SLICE_ROWS):
        from segrank.session import apply_runtime_conf
        apply_runtime_conf(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self.budget = budget
        self.slice_rows = slice_rows

    # ------------------------------------------------------------ documents
    @cached_property
    def corpus(self) -> DataFrame:
        return testdata.corpus(self.spark, self.sf_dir)

    @cached_property
    def doc_psgs(self) -> DataFrame:
        """Nested ``(doc_id, psgs)``; per-document work on it needs no shuffle."""
        return segment.doc_passages(self.corpus, self.budget)

    @cached_property
    def passages(self) -> DataFrame:
        """``(doc_id, psg, text, n_tok, n_psg)``."""
        return (self.doc_psgs.select("doc_id", F.inline_outer("psgs"))
                .filter(F.col("psg").isNotNull())
                .select("doc_id", "psg", "text", "n_tok", "n_psg"))

    # -------------------------------------------------------- stored layer
    @cached_property
    def store(self) -> Store:
        return Store(self.spark, {n: f"{self.sf_dir.rstrip('/')}/{n}.parquet" for n in ("documents", "benchmark", "labels")})

    @property
    def buckets(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @cached_property
    def forward(self) -> DataFrame:
        """``(doc_id, n_psg, dl, psgs ARRAY<ARRAY<term>>)``: the text is split and tokenised once."""
        return self.store.table("forward", ["documents"], lambda: postings.forward_rows(self.doc_psgs.select(
            "doc_id", F.transform("psgs", lambda x: tokens_of(x["text"])).alias("psgs"))), budget=self.budget)

    @cached_property
    def lengths(self) -> DataFrame:
        """``(doc_id, dl, dls)``: the length of a document and of its first 1 .. SWEEP passages."""
        run = [F.aggregate(F.slice("psgs", 1, n), F.lit(0), lambda a, p: a + F.size(p)) for n in range(1, postings.SWEEP + 1)]
        return self.store.table("lengths", ["documents"], lambda: self.forward.select("doc_id", "dl", F.array(*run).alias("dls")),
                                budget=self.budget, sweep=postings.SWEEP)

    @cached_property
    def collection(self) -> Collection:
        """Sizes of the collection: one row of sums, read once a session."""
        sums = [F.coalesce(F.sum(F.col("dls")[n]), F.lit(0)).alias(f"t{n}") for n in range(postings.SWEEP)]
        row = self.store.table("collection", ["documents"], lambda: self.lengths.agg(
            F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), *sums), budget=self.budget).first()
        return Collection(row[0], row[1], tuple(row[2:]))

    @cached_property
    def lexicon(self) -> DataFrame:
        """``(term, df, cf, dfs, slices)``."""
        return self.store.table("lexicon", ["documents"], lambda: postings.lexicon_rows(
            self.forward, slice_rows=self.slice_rows), budget=self.budget, slice_rows=self.slice_rows)

    @cached_property
    def postings(self) -> DataFrame:
        """``(term, slice, doc_id, n_psg, dl, tf, hits, df)``, bucketed by (term, slice); ``sliced`` gives them sorted, so the
        write need not compare them again."""
        return self.store.bucketed("postings", ["documents"], lambda: postings.sliced(
            postings.posting_blocks(self.forward), self.lexicon, small, self.buckets), ["term", "slice"], [],
            self.buckets, budget=self.budget, slice_rows=self.slice_rows)

    @cached_property
    def bm25_top(self) -> DataFrame:
        """The BM25 run (top 1000) that candidates, triplets and splits are taken from."""
        return self.store.table("bm25", ["documents", "benchmark"], lambda: bm25(self, self.query_tokens, 1000), budget=self.budget)

    @cached_property
    def doc_lengths(self) -> DataFrame:
        """``(doc_id, n_psg)`` of the documents that have a passage."""
        return self.forward.where("n_psg > 0").select("doc_id", "n_psg")

    @cached_property
    def differences(self) -> DataFrame:
        """K15's input: the feature differences of every training triplet."""
        from segrank.plans.queries_rerank import triplet_differences
        return self.store.table("differences", ["documents", "benchmark", "labels"], lambda: triplet_differences(self), budget=self.budget)

    @cached_property
    def tokens(self) -> DataFrame:
        """``(doc_id, psg, n_psg, n_tok, pos, term)``."""
        psgs = self.forward.select("doc_id", "n_psg", F.posexplode("psgs").alias("psg", "t"))
        return psgs.select("doc_id", "psg", "n_psg", F.size("t").alias("n_tok"), F.posexplode("t").alias("pos", "term"))

    def first_n_docs(self, n: int | None) -> DataFrame:
        """Documents made of their first ``n`` passages (T7 on the nested
        form, all passages when ``n`` is None): ``(doc_id, text)``."""
        if n is None:
            return self.doc_psgs.select(
                "doc_id", F.array_join(F.transform("psgs", lambda x: x["text"]), " ").alias("text"))
        return segment.first_k_text_nested(self.doc_psgs, n)

    # ------------------------------------------------------------ queries
    @cached_property
    def queries(self) -> DataFrame:
        b = testdata.table(self.spark, self.sf_dir, "benchmark")
        return b.select(F.col("item_id").cast("string").alias("qid"),
                        F.array_join(tokens_of(F.col("text")), " ").alias("text"))

    @cached_property
    def query_tokens(self) -> DataFrame:
        """``(qid, pos, term)``."""
        return (self.queries.select("qid", F.posexplode_outer(tokens_of(F.col("text"))).alias("pos", "term"))
                .filter(F.col("term").isNotNull()))

    @cached_property
    def qrels(self) -> DataFrame:
        """``(qid, doc_id, rel)``: verbatim containment of the benchmark text in the raw document text.  Judgements are an
        input table in the reference; here they are derived from every document, once."""
        return self.store.table("qrels", ["documents", "benchmark", "labels"], self._qrels)

    def _qrels(self) -> DataFrame:
        """A document that contains an item has the item's interior words (the first and last may be cut) as a run of
        words, so one run of up to ``GRAM`` interior words is the join key and only the documents that have it are searched
        for the whole text.  Items without interior words are searched in every document row, in blocks."""
        words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        b = testdata.table(self.spark, self.sf_dir, "benchmark").select(
            F.col("item_id").cast("string").alias("qid"), F.col("text").alias("btext"), words(F.col("text")).alias("w"))
        docs = testdata.table(self.spark, self.sf_dir, "documents").select(
            F.col("doc_id").cast("string").alias("doc_id"), "text")
        hits = self._found_by_gram(b.where(F.size("w") >= 3), docs, words)
        short = b.where(F.size("w") < 3).select("qid", "btext").collect()
        for k in range(0, len(short), SHORT_ITEMS):
            items = F.array(*[F.struct(F.lit(r["qid"]).alias("qid"), F.lit(r["btext"]).alias("btext")) for r in short[k:k + SHORT_ITEMS]])
            hits = hits.unionByName(docs.select(F.explode(F.filter(items, lambda x: F.col("text").contains(x["btext"]))).alias("x"), "doc_id")
                                    .select("x.qid", "doc_id"))
        labels = testdata.table(self.spark, self.sf_dir, "labels").select(
            F.col("doc_id").cast("string").alias("doc_id"), "quality")
        return hits.join(labels, "doc_id", "left").select(
            "qid", "doc_id", (F.lit(1) + F.coalesce(F.col("quality"), F.lit(0))).cast("int").alias("rel"))

    def _found_by_gram(self, b: DataFrame, docs: DataFrame, words) -> DataFrame:
        b = b.withColumn("gram", F.slice("w", F.lit(2), F.least(F.lit(GRAM), F.size("w") - 2)))
        w = testdata.spread(docs).select("doc_id", words(F.col("text")).alias("w")).where("w IS NOT NULL")
        cand = None
        for block in query_blocks(b.select("qid", "gram")):
            found = w.mapInArrow(with_run([(r["qid"], r["gram"]) for r in block]), "qid string, doc_id string")
            cand = found if cand is None else cand.unionByName(found)
        return (cand.distinct().join(b.select("qid", "btext"), "qid").join(docs, "doc_id")
                .filter(F.col("text").contains(F.col("btext"))).select("qid", "doc_id"))

    # ------------------------------------------------------------ weights
    @cached_property
    def term_weights(self) -> DataFrame:
        """``(term, scale)``, ``scale = ln(1 + N/df)``."""
        return self.lexicon.select("term", self.scale(F.col("df")).alias("scale"))

    def scale(self, df):
        return F.log(F.lit(1.0) + F.lit(float(self.collection.n_docs)) / df)

    def weight(self, tf, df):
        """A passage's quantised weight of a term."""
        return quantise(self.scale(df) * (F.lit(1.0) + F.log(tf.cast("double"))))

    @cached_property
    def passage_tf(self) -> DataFrame:
        """``(doc_id, psg, n_psg, term, tf, df)``, read from the postings."""
        return self.postings.select("doc_id", "n_psg", "term", "df", F.inline("hits"))

    @cached_property
    def impacts(self) -> DataFrame:
        """Passage vectors ``(doc_id, psg, n_psg, term, w)``: a posting knows its df, so no join is needed."""
        return (self.passage_tf.select("doc_id", "psg", "n_psg", "term", self.weight(F.col("tf"), F.col("df")).alias("w"))
                .where("w <> 0"))

    @cached_property
    def query_impacts(self) -> DataFrame:
        return vectors.query_impacts(self.query_tokens, self.term_weights)

    @cached_property
    def n_docs(self) -> DataFrame:
        """One row ``(n_docs)``."""
        return self.corpus.agg(F.count(F.lit(1)).alias("n_docs"))

    @cached_property
    def term_df(self) -> DataFrame:
        return self.lexicon.select("term", "df")

    @cached_property
    def expansion(self) -> DataFrame:
        """``(src_term, term, s)``: all neighbours within 2 positions of all terms (Dice), and each term itself (1)."""
        return self.store.table("expansion", ["documents"], lambda: vectors.dice_expansion(
            vectors.window_pair_counts(self.forward), self.lexicon), budget=self.budget)

    @cached_property
    def weighty_expansion(self) -> DataFrame:
        """The rows of ``expansion`` that can have a weight."""
        return self.store.table("weighty", ["documents"], lambda: vectors.weighty_expansion(self.forward, self.lexicon), budget=self.budget)

    def expansion_between(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """The rows of ``expansion`` from a term of ``sources(qid, term)`` to a term of ``targets(qid, term)`` of the same query, with the same
        weights (and some others): only these pairs are counted, so what is exchanged grows with the queries' candidates."""
        asked = vectors.asked_terms(sources, targets)
        if asked is None:
            return self.expansion
        terms = small(sources.select("term").unionByName(targets.select("term")).distinct())
        from segrank.session import cut_lineage
        known = cut_lineage(self.lexicon.join(terms, "term", "left_semi").select("term", "cf"))       # read three times, so it is kept
        return vectors.dice_expansion(vectors.window_pair_counts(self.forward, asked=asked), known)

    @cached_property
    def query_slots(self) -> DataFrame:
        """``(qid, i, term, wq, q_len)``: the queries' positions with their weights."""
        return sdm.query_slots(self.query_tokens, self.term_weights)

    @cached_property
    def passage_terms(self) -> DataFrame:
        """``(doc_id, psg, terms ARRAY)``."""
        return self.forward.select("doc_id", F.posexplode("psgs").alias("psg", "terms"))

    def doc_vectors(self, mode: str, n: int | None) -> DataFrame:
        from segrank.operators.aggregate import aggregate_passages
        return aggregate_passages(self.impacts, mode, n)


def with_run(items: list):
    """Arrow function: documents ``(doc_id, w ARRAY<word>)`` to the ``(qid, doc_id)`` where the words have an item's run of words, ``items``
    being ``(qid, run)``.  Words are numbered, and each stretch of numbers is looked up; a stretch whose number wraps around
    may name a document that has it not, so the whole text is to be searched afterwards."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        known = {word: i + 1 for i, word in enumerate(dict.fromkeys(word for _, gram in items for word in gram))}     # 0: another word
        base = np.uint64(len(known) + 1)

        def keys(numbers, g: int):
            key = np.zeros(len(numbers) - g + 1, np.uint64)
            for k in range(g):
                key = key * base + numbers[k:k + len(key)]
            return key

        wanted: dict[int, dict[int, list]] = {}
        for qid, gram in items:
            key = int(keys(np.array([known[x] for x in gram], np.uint64), len(gram))[0])
            wanted.setdefault(len(gram), {}).setdefault(key, []).append(qid)
        sought = {g: np.array(sorted(by), np.uint64) for g, by in wanted.items()}
        words = pa.array(list(known), pa.string())
        for batch in batches:
            lists = batch.column("w")
            doc = pc.list_parent_indices(lists).to_numpy()
            numbers = pc.fill_null(pc.add(pc.index_in(pc.list_flatten(lists), value_set=words), 1), 0).to_numpy().astype(np.uint64)
            qids, docs = [], []
            for g, some in sought.items():
                if len(numbers) < g:
                    continue
                key = keys(numbers, g)
                at = np.minimum(np.searchsorted(some, key), len(some) - 1)
                hit = np.flatnonzero((some[at] == key) & (doc[:len(key)] == doc[g - 1:]))
                for d, k in {(int(doc[i]), int(key[i])) for i in hit}:
                    qids += wanted[g][k]
                    docs += [d] * len(wanted[g][k])
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.string()), batch.column("doc_id").take(pa.array(docs, pa.int64()))], ["qid", "doc_id"])
    return run


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
