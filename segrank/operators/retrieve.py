"""Retrieval over stored postings and the BM25 family.

Every scorer meets the postings (``operators.postings``) once: those of the query terms are dealt by document, and each task
sums the scores of its documents against the whole query side (``operators.topk``).  No row is made for a (query, document)
pair but the best ``k`` of a task; the top-k cut over them is a window group limit.

The first-n-passages variants (R7) are columns, not rows: a posting knows the tf of each passage, the lexicon the df for
every n, and a document its running lengths, so one row yields the scores for all n, and nothing is multiplied by n before
the aggregation.  ``ns`` lists the variants; None stands for whole documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segrank.functions.numeric import r6
from segrank.operators.postings import _stretches, total_tf
from segrank.operators.topk import best, query_blocks
from segrank.plans.util import small
from segrank.session import cut_lineage

# fixed values (parameters of the lexical runs)
BM25_K1 = 0.9
BM25_B = 0.4
RM3_FB_DOCS = 10
RM3_FB_TERMS = 10
RM3_ORIG_WEIGHT = 0.5
SDM_WEIGHTS = (0.85, 0.15, 0.05)  # term, ordered, unordered
SDM_WINDOW = 8



@dataclass(frozen=True)
class Collection:
    """Documents, their summed length, and the summed length of their first n = 1.. passages."""
    n_docs: int
    total: int
    totals: tuple[int, ...]

    def avgdl(self, n: int | None) -> float:
        total = self.total if n is None else self.totals[n - 1]
        return total / self.n_docs if self.n_docs else 0.0


def top_k(scored: DataFrame, k: int, key: str | list[str] = "qid", item: str = "doc_id",
          score: str = "score") -> DataFrame:
    """Top ``k`` per query by ``score desc, item asc`` with a dense rank column."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item).asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .withColumn("rank", F.col("rank").cast("int"))


def top_passages(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc(), F.col("psg").asc())
    return scores.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k) \
        .select("qid", "doc_id", "psg", "rank", "score")


# ------------------------------------------------------ dot products on postings

def retrieve_first(postings: DataFrame, query_vec: DataFrame, lexicon: DataFrame, weight, n: int | None, k: int = 1000) -> DataFrame:
    """R2 on postings: documents by the dot product with the maximum of their first ``n`` passages' weights.  ``weight``
    maps (tf, df) to a passage weight that grows with tf, so a document's maximum is that of its largest tf and is
    found in the posting."""
    hits = F.col("hits") if n is None else F.filter("hits", lambda h: h["psg"] < n)
    largest = F.array_max(F.transform(hits, lambda h: h["tf"]))

    def rows(m: DataFrame) -> DataFrame:
        m = m.withColumn("tf", largest).where("tf IS NOT NULL")
        return m.withColumn("w", F.greatest(weight(F.col("tf"), F.col("df")), F.lit(0))).where("w <> 0").select("doc_id", "no", "w")

    return top_k(best(_impacts(query_vec, lexicon), lambda known: rows(postings.join(known, "term")), [F.col("w")], k, ["term"]), k).select("qid", "doc_id", "rank", "score")


def retrieve_passages_first(postings: DataFrame, query_vec: DataFrame, lexicon: DataFrame, weight, k: int = 10000) -> DataFrame:
    """R3 on postings: every hit of a posting is a passage."""
    def rows(m: DataFrame) -> DataFrame:
        m = m.select("doc_id", "no", "df", F.inline("hits"))
        return m.withColumn("w", weight(F.col("tf"), F.col("df"))).where("w <> 0").select("doc_id", "psg", "no", "w")

    return top_passages(best(_impacts(query_vec, lexicon), lambda known: rows(postings.join(known, "term")), [F.col("w")], k, ["term"], passages=True), k)


def _impacts(query_vec: DataFrame, lexicon: DataFrame) -> DataFrame:
    return query_vec.join(lexicon.select("term"), "term").select("qid", "term", F.array(F.col("qw").cast("double")).alias("ws"))


def vector_sweep(postings: DataFrame, query_vec: DataFrame, lexicon: DataFrame, weight, ns: list[int], k: int = 1000) -> DataFrame:
    """A7 as the jobs run it: documents retrieved by the max, sum and mean of their first n passages' weights, for all
    ``ns`` in one pass -> ``(mode, n, qid, doc_id, rank, score)``.  A posting is dealt with its passages' weights; the values of
    the variants are made of them where the document is scored."""
    sums = {}
    first = lambda n: F.transform(F.filter("ws", lambda h: h["psg"] < n), lambda h: h["w"])
    for n in ns:
        mine = first(n)
        total = F.aggregate(mine, F.lit(0.0), lambda a, x: a + x)
        sums["max", n] = F.when(F.size(mine) > 0, F.greatest(F.array_max(mine), F.lit(0.0)))
        sums["sum", n] = F.when(F.size(mine) > 0, total)
        sums["mean", n] = F.when(F.size(mine) > 0, total / F.least(F.lit(n), F.col("n_psg")))
    rows = lambda m: m.select("doc_id", "no", "n_psg", F.transform(F.filter("hits", lambda h: h["psg"] < max(ns)), lambda h: F.struct(
        h["psg"].alias("psg"), weight(h["tf"], F.col("df")).cast("double").alias("w"))).alias("ws")).where(F.size("ws") > 0)
    found = best(_impacts(query_vec, lexicon), lambda known: rows(postings.join(known, "term")), list(sums.values()), k, ["term"])
    names = F.array(*[F.struct(F.lit(mode).alias("mode"), F.lit(n).alias("n")) for mode, n in sums])
    named = found.select(names[F.col("variant")].alias("x"), "qid", "doc_id", "score").select("x.mode", "x.n", "qid", "doc_id", "score")
    return top_k(named, k, ["mode", "n", "qid"]).select("mode", "n", "qid", "doc_id", "rank", "score")


# ---------------------------------------------------------------- BM25 family

def _bm25_term(tf: Column, df: Column, dl: Column, n_docs: Column, avgdl: Column,
               k1: float, b: float) -> Column:
    idf = F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl)
    return idf * tf / (tf + norm)


def _column(ns: list) -> list[str]:
    return [f"s{k}" for k in range(len(ns))]


def _with_lengths(rows: DataFrame, lengths: DataFrame, ns: list) -> DataFrame:
    """The documents' running lengths, needed for first-n variants only."""
    return rows if ns == [None] else rows.join(lengths.select("doc_id", "dls"), "doc_id")


def _dl(n: int | None) -> Column:
    return F.col("dl") if n is None else F.col("dls")[n - 1]


def term_values(m: DataFrame, lengths: DataFrame, coll: Collection, ns: list, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """``(doc_id, no, s0, s1, ..)`` of postings: what a term's BM25 score is for each variant of ``ns``, before the term's weight in
    the query (null: the document has it not)."""
    m = _with_lengths(m, lengths, ns)
    cols = []
    for i, n in enumerate(ns):
        tf = F.col("tf") if n is None else total_tf(F.col("hits"), n)
        df = F.col("df") if n is None else F.col("dfs")[n - 1]
        s = _bm25_term(tf.cast("double"), df.cast("double"), _dl(n).cast("double"), F.lit(float(coll.n_docs)), F.lit(coll.avgdl(n)), k1, b)
        cols.append((s if n is None else F.when(F.col("hits")[0]["psg"] < n, s)).alias(f"s{i}"))
    return m.select("doc_id", "no", *cols)


def term_run(ix, weights: DataFrame, ns: list, k: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 run of weighted query terms, ``weights(qid, term, ws ARRAY<DOUBLE>)`` with a weight for each variant."""
    swept = [] if ns == [None] else ["dfs"]
    q = weights.join(ix.lexicon.select("term", *swept), "term")
    found = best(q, lambda known: term_values(ix.postings.join(known, "term"), ix.lengths, ix.collection, ns, k1, b), [F.col(c) for c in _column(ns)], k, ["term"], swept)
    return ranked(found, ns, k)


def ranked(found: DataFrame, ns: list, k: int) -> DataFrame:
    """``(n, qid, doc_id, rank, score)`` from the best of each task; without ``n`` for whole documents alone."""
    if ns == [None]:
        return top_k(found, k).select("qid", "doc_id", "rank", "score")
    rows = found.withColumn("n", F.array(*map(F.lit, ns))[F.col("variant")])
    return top_k(rows, k, ["n", "qid"]).select("n", "qid", "doc_id", "rank", "score")


def query_term_counts(query_tokens: DataFrame) -> DataFrame:
    """``(qid, term, qweight)`` = query term frequency (duplicated clauses add)."""
    return query_tokens.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("qweight"))


def same_weights(query_weights: DataFrame, ns: list, *unit) -> DataFrame:
    return query_weights.select("qid", *(unit or ["term"]), F.array_repeat("qweight", len(ns)).alias("ws"))


def bm25(ix, query_tokens: DataFrame, k: int = 1000, ns: list | None = None, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """R4, and R7 for ``ns``: BM25 runs.  ``ix`` has ``postings``, ``lexicon``, ``lengths``, ``forward`` and ``collection``."""
    ns = ns or [None]
    return term_run(ix, same_weights(query_term_counts(query_tokens), ns), ns, k, k1, b)


def rm3(ix, query_tokens: DataFrame, k: int = 1000, ns: list | None = None, fb_docs: int = RM3_FB_DOCS,
        fb_terms: int = RM3_FB_TERMS, orig_weight: float = RM3_ORIG_WEIGHT, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """R5 (R7 for ``ns``): BM25 -> relevance model from the top ``fb_docs`` documents (``P(t|R) ~ sum_d score_d / sum(score) *
    tf(t,d) / dl(d)``), top ``fb_terms`` terms renormalised, interpolated with the query model, BM25 again."""
    ns = ns or [None]
    one = ns == [None]
    key = ["qid"] if one else ["n", "qid"]
    counts = query_term_counts(query_tokens)
    first = cut_lineage(term_run(ix, same_weights(counts, ns), ns, fb_docs, k1, b))      # fb_docs rows a query and variant, read twice
    fb = first.withColumn("sn", F.col("score") / F.sum("score").over(Window.partitionBy(key))).select(*key, "doc_id", "sn")
    # fb_docs rows a query and variant meet the forward rows; a variant reads the first n passages of the row
    parts = F.col("psgs") if one else F.slice("psgs", F.lit(1), F.col("n"))
    fed = (ix.forward.select("doc_id", "psgs").join(small(fb), "doc_id").select(*key, "doc_id", "sn", F.flatten(parts).alias("t"))
           .select(*key, "doc_id", "sn", F.size("t").alias("dl"), F.explode("t").alias("term")))
    tf = fed.groupBy(*key, "doc_id", "sn", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    model = tf.groupBy(*key, "term").agg(F.round(F.sum(F.col("sn") * F.col("tf") / F.col("dl")), 9).alias("p"))
    kept = top_k(model, fb_terms, key, item="term", score="p")
    kept = kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key)))
    at = F.lit(0) if one else F.array_position(F.array(*map(F.lit, ns)), F.col("n")).cast("int") - 1
    fed_weights = kept.select("qid", "term", at.alias("at"), (F.lit(1.0 - orig_weight) * F.col("p")).alias("weight"))
    own = counts.withColumn("p", F.col("qweight") / F.sum("qweight").over(Window.partitionBy("qid"))) \
        .select("qid", "term", F.explode(F.sequence(F.lit(0), F.lit(len(ns) - 1))).alias("at"), (F.lit(orig_weight) * F.col("p")).alias("weight"))
    mixed = own.unionByName(fed_weights).groupBy("qid", "term").agg(
        F.array(*[F.sum(F.when(F.col("at") == i, F.col("weight"))) for i in range(len(ns))]).alias("ws"))
    return term_run(ix, mixed, ns, k, k1, b)


def query_pairs(query_tokens: DataFrame) -> DataFrame:
    """``(qid, t1, t2, qweight)`` of terms that follow each other in a query."""
    after = F.lead("term").over(Window.partitionBy("qid").orderBy("pos"))
    return (query_tokens.select("qid", F.col("term").alias("t1"), after.alias("t2")).where("t2 IS NOT NULL")
            .groupBy("qid", "t1", "t2").agg(F.count(F.lit(1)).cast("double").alias("qweight")))


def pair_counts(forward: DataFrame, pairs: DataFrame, ns: list, window: int = SDM_WINDOW) -> DataFrame:
    """``(doc_id, dl, t1, t2, od0, uw0, od1, ..)``: how often the terms follow each other, and stand within ``window``
    positions in either order, for each variant.  Both counts are made where the document is, of the positions that hold a
    word of a pair: no row is made for a position, and only the counts of a document and pair are exchanged."""
    kind = forward.schema["doc_id"].dataType.simpleString()
    names = [f"{c}{i}" for i in range(len(ns)) for c in ("od", "uw")]
    rows = None
    for block in query_blocks(pairs.select("t1", "t2").distinct(), by=["t1", "t2"]):
        found = forward.select("doc_id", "dl", "psgs").mapInArrow(_count_query_pairs([(r["t1"], r["t2"]) for r in block], ns, window),
                                                                 f"doc_id {kind}, dl int, t1 string, t2 string, " + ", ".join(f"{c} bigint" for c in names))
        rows = found if rows is None else rows.unionByName(found)
    return rows.groupBy("doc_id", "dl", "t1", "t2").agg(*[F.sum(c).alias(c) for c in names])      # a document may have several rows


def _count_query_pairs(pairs: list, ns: list, window: int):
    """Arrow function of :func:`pair_counts`, a stretch of documents at a time."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        known = {w: i for i, w in enumerate(dict.fromkeys(w for pair in pairs for w in pair))}
        many, sought = max(1, len(known)), pa.array(list(known), pa.string())
        first, second = (np.array([known[pair[c]] for pair in pairs], np.int64) for c in (0, 1))
        tables = []      # codes of two words in the order they stand in, and the pair they belong to: as asked for, and the other way round
        for code in (first * many + second, second * many + first):
            order = np.argsort(code)
            tables.append((code[order], order))
        t1, t2 = (pa.array([pair[c] for pair in pairs], pa.string()) for c in (0, 1))
        maybe = np.zeros(1 << 22, bool)      # most codes are of no pair; this tells so without a search
        for code, _ in tables:
            maybe[code & (len(maybe) - 1)] = True
        schema = ["doc_id", "dl", "t1", "t2", *[f"{kind}{i}" for i in range(len(ns)) for kind in ("od", "uw")]]
        for rows, doc, psg, term, words in _stretches(batches):
            word = pc.fill_null(pc.index_in(words, value_set=sought), -1).to_numpy(zero_copy_only=False).astype(np.int64)[term]
            at = np.flatnonzero(word >= 0)
            word, where, part = word[at], doc[at], psg[at]
            found = []      # row and pair, passage of the later word, and whether it follows as asked for
            for step in range(1, window):
                near = np.flatnonzero((at[step:] - at[:-step] < window) & (where[step:] == where[:-step]))
                code = word[near] * many + word[near + step]
                some = maybe[code & (len(maybe) - 1)]
                near, code = near[some], code[some]
                for ahead, (codes, pair) in zip((True, False), tables):
                    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    hit = np.flatnonzero(codes[place] == code)
                    left, right = near[hit], near[hit] + step
                    found.append((where[left] * len(pairs) + pair[place[hit]], part[right], (at[right] - at[left] == 1) & ahead))
            key, later, follows = (np.concatenate([f[c] for f in found]) for c in range(3))
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, later, follows = key[order], later[order], follows[order]
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts = []
            for n in ns:
                within = np.ones(len(key), bool) if n is None else later < n
                counts += [np.add.reduceat((within & follows).astype(np.int64), begins), np.add.reduceat(within.astype(np.int64), begins)]
            key = key[begins]
            docs = rows.select(["doc_id", "dl"]).take(pa.array(key // len(pairs)))
            of = pa.array(key % len(pairs))
            yield pa.RecordBatch.from_arrays([*docs.columns, t1.take(of), t2.take(of), *[pa.array(c) for c in counts]], schema)
    return run


def pair_values(ix, pairs: DataFrame, ns: list, ordered: float, unordered: float, window: int,
                k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """``(doc_id, t1, t2, s0, ..)``: weighted BM25 values of ordered and unordered query pairs, before the pair's weight in the query."""
    counts = pair_counts(ix.forward, pairs, ns, window)
    kinds = [f"{kind}{i}" for i in range(len(ns)) for kind in ("od", "uw")]
    dfs = counts.groupBy("t1", "t2").agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(f"df_{c}") for c in kinds])
    m = _with_lengths(counts.join(dfs, ["t1", "t2"]), ix.lengths, ns)
    cols = []
    for i, n in enumerate(ns):
        both = [F.lit(weight) * _bm25_term(
            F.col(f"{kind}{i}").cast("double"), F.col(f"df_{kind}{i}").cast("double"), _dl(n).cast("double"),
            F.lit(float(ix.collection.n_docs)), F.lit(ix.collection.avgdl(n)), k1, b) for kind, weight in (("od", ordered), ("uw", unordered))]
        od, uw = (F.when(F.col(f"{kind}{i}") > 0, s) for kind, s in zip(("od", "uw"), both))
        cols.append(F.when(F.col(f"uw{i}") > 0, uw + F.coalesce(od, F.lit(0.0))).alias(f"s{i}"))
    return m.select("doc_id", "t1", "t2", *cols)


def sdm_bm25(ix, query_tokens: DataFrame, k: int = 1000, ns: list | None = None, weights=SDM_WEIGHTS, window: int = SDM_WINDOW,
             k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """R6 (R7 for ``ns``): sequential-dependence BM25: weighted sum of unigram, ordered-pair and unordered-window BM25
    scores (weights as given, not renormalised).  A pair is a term with two words: its values are dealt with the terms'."""
    ns = ns or [None]
    swept = [] if ns == [None] else ["dfs"]
    counts, pairs = query_term_counts(query_tokens), query_pairs(query_tokens)
    none = F.lit(None).cast("string")
    uni = counts.withColumn("qweight", F.lit(weights[0]) * F.col("qweight")).join(ix.lexicon.select("term", *swept), "term")
    q = same_weights(uni, ns, F.col("term").alias("t1"), none.alias("t2"), *swept).unionByName(
        same_weights(pairs, ns, "t1", "t2"), allowMissingColumns=True)
    pair_rows = pair_values(ix, pairs, ns, weights[1], weights[2], window, k1, b)

    def rows(known: DataFrame) -> DataFrame:
        terms = known.where("t2 IS NULL").withColumnRenamed("t1", "term").drop("t2")
        m = ix.postings.join(F.broadcast(terms), "term")
        p = pair_rows.join(F.broadcast(known.where("t2 IS NOT NULL").select("t1", "t2", "no")), ["t1", "t2"])
        return term_values(m, ix.lengths, ix.collection, ns, k1, b).unionByName(p.select("doc_id", "no", *_column(ns)))

    return ranked(best(q, rows, [F.col(c) for c in _column(ns)], k, ["t1", "t2"], swept), ns, k)
