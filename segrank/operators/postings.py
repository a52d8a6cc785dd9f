"""The stored forward and inverted tables that retrieval reads.

* ``forward(doc_id, n_psg, dl, psgs)``: a document's tokens, passage by passage, in one row.
* ``lexicon(term, df, cf, dfs, slices)``: documents that have the term, its occurrences, and for n = 1.. the documents that
  have it in their first n passages, all from one count of first passages.
* ``postings(term, slice, doc_id, n_psg, dl, tf, hits, df)``: a row for each (term, document); ``hits`` has the tf of each
  passage.  Everything that a score needs travels with the row.  The table is bucketed and sorted by (term, slice): a
  join with query terms does not exchange it.  A term in more than ``SLICE_ROWS`` documents is cut into ``slices`` by a
  hash of the document, so that no bucket holds a whole stop word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 2_000_000      # postings of a term in one bucket, about
SWEEP = 10                  # the largest n of the first-n-passages sweeps


def forward_rows(doc_terms: DataFrame) -> DataFrame:
    """``forward`` from ``(doc_id, psgs ARRAY<ARRAY<term>>)``."""
    return doc_terms.select("doc_id", F.size("psgs").alias("n_psg"), F.size(F.flatten("psgs")).alias("dl"), "psgs")


def document_postings(forward: DataFrame) -> DataFrame:
    """``(doc_id, n_psg, dl, term, tf, hits ARRAY<STRUCT<psg, tf>>)`` made of each document row, without a shuffle: equal
    (term, passage) of a document are counted, a stretch of documents at a time, and those of a term are put together."""
    kind = forward.schema["doc_id"].dataType.simpleString()
    return forward.select("doc_id", "n_psg", "dl", "psgs").mapInArrow(
        _count_terms, f"doc_id {kind}, n_psg int, dl int, term string, tf int, hits array<struct<psg:int,tf:int>>")


def posting_blocks(forward: DataFrame) -> DataFrame:
    """``(term, docs ARRAY<STRUCT<doc_id, n_psg, dl, tf, hits>>)``: the rows of :func:`document_postings`, those of a term and a stretch
    of documents in one row, so that an exchange moves and sorts a row for each (term, stretch)."""
    kind = forward.schema["doc_id"].dataType.simpleString()
    return forward.select("doc_id", "n_psg", "dl", "psgs").mapInArrow(
        _count_blocks, f"term string, docs array<struct<doc_id:{kind},n_psg:int,dl:int,tf:int,hits:array<struct<psg:int,tf:int>>>>")


TOKENS_AT_ONCE = 1_000_000   # tokens of the documents that are counted together, about


def _stretches(batches):
    """``(rows, doc, psg, term, words)`` of documents that are counted together: for each token the number of its row, of its
    passage and of its term in ``words``.  Tokens come by row and passage."""
    import numpy as np
    import pyarrow.compute as pc
    for batch in batches:
        size = pc.fill_null(batch.column("dl"), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(np.maximum(size, 0)) // TOKENS_AT_ONCE
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), batch.num_rows] if batch.num_rows else []
        for low, high in zip(cuts[:-1], cuts[1:]):
            rows = batch.slice(low, high - low)
            doc_of = rows.column("psgs")
            parents = pc.list_parent_indices(doc_of).to_numpy()           # of each passage
            passages = pc.list_flatten(doc_of)
            psg_of = pc.list_parent_indices(passages).to_numpy()          # of each token
            words = pc.list_flatten(passages).dictionary_encode()
            if len(words):
                number = np.arange(len(parents)) - np.searchsorted(parents, parents)
                yield rows, parents[psg_of], number[psg_of], words.indices.to_numpy().astype(np.int64), words.dictionary


def _firsts(*columns):
    import numpy as np
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _counted(rows, doc, psg, term, by_term: bool):
    """The postings of a stretch, by (row, term) or by (term, row): the terms' numbers and the arrays doc_id, n_psg, dl, tf, hits."""
    import numpy as np
    import pyarrow as pa
    order = np.argsort(term * rows.num_rows + doc if by_term else doc * (int(term.max()) + 1) + term, kind="stable")
    doc, psg, term = doc[order], psg[order], term[order]
    hit = _firsts(doc, term, psg)
    tf = np.diff(np.r_[hit, len(doc)])
    first = _firsts(doc[hit], term[hit])
    at = hit[first]
    hits = pa.ListArray.from_arrays(pa.array(np.r_[first, len(hit)], pa.int32()), pa.StructArray.from_arrays(
        [pa.array(psg[hit], pa.int32()), pa.array(tf, pa.int32())], ["psg", "tf"]))
    keys = rows.select(["doc_id", "n_psg", "dl"]).take(pa.array(doc[at]))
    return term[at], [*keys.columns, pa.array(np.add.reduceat(tf, first), pa.int32()), hits]


def _count_terms(batches):
    """Arrow function of :func:`document_postings`."""
    import pyarrow as pa
    for rows, doc, psg, term, words in _stretches(batches):
        term, (*keys, tf, hits) = _counted(rows, doc, psg, term, False)
        yield pa.RecordBatch.from_arrays([*keys, words.take(pa.array(term)), tf, hits], ["doc_id", "n_psg", "dl", "term", "tf", "hits"])


def _count_blocks(batches):
    """Arrow function of :func:`posting_blocks`."""
    import numpy as np
    import pyarrow as pa
    for rows, doc, psg, term, words in _stretches(batches):
        term, columns = _counted(rows, doc, psg, term, True)
        begins = _firsts(term)
        docs = pa.StructArray.from_arrays(columns, ["doc_id", "n_psg", "dl", "tf", "hits"])
        yield pa.RecordBatch.from_arrays([words.take(pa.array(term[begins])), pa.ListArray.from_arrays(
            pa.array(np.r_[begins, len(term)], pa.int32()), docs)], ["term", "docs"])


def total_tf(hits: Column, n: int | None = None) -> Column:
    """Occurrences in the first ``n`` passages (all: None)."""
    part = (lambda h: h["tf"]) if n is None else (lambda h: F.when(h["psg"] < n, h["tf"]).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda s, h: s + part(h))


def lexicon_rows(forward: DataFrame, sweep: int = SWEEP, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``lexicon`` from ``forward``: each stretch of documents is counted where it is, and one row of counts a term and task is
    exchanged."""
    names = ["df", "cf", *[f"df_{n}" for n in range(1, sweep + 1)]]
    counts = forward.select("dl", "psgs").mapInArrow(_count_lexicon(sweep), "term string, " + ", ".join(f"{c} bigint" for c in names)) \
        .groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
    return counts.select("term", "df", "cf", F.array(*[f"df_{n}" for n in range(1, sweep + 1)]).alias("dfs"),
                         F.ceil(F.col("df") / F.lit(slice_rows)).cast("int").alias("slices"))


def _count_lexicon(sweep: int):
    """Arrow function: ``(term, df, cf, df_1, ..)`` of each stretch."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for _, doc, psg, term, words in _stretches(batches):
            many = len(words)
            _, first = np.unique(doc * many + term, return_index=True)     # a document's first token of the term is in its first passage with it
            place = np.minimum(psg[first], sweep)
            within = np.bincount(term[first] * (sweep + 1) + place, minlength=many * (sweep + 1)).reshape(many, sweep + 1).cumsum(axis=1)
            columns = [within[:, sweep], np.bincount(term, minlength=many), *[within[:, n] for n in range(sweep)]]
            yield pa.RecordBatch.from_arrays([words, *[pa.array(c, pa.int64()) for c in columns]], ["term", "df", "cf", *[f"df_{n}" for n in range(1, sweep + 1)]])
    return run


def sliced(blocks: DataFrame, lexicon: DataFrame, broadcast, buckets: int) -> DataFrame:
    """``postings`` rows from :func:`posting_blocks`, dealt and sorted by (term, slice).  A light term has all its blocks together,
    so its df is the number of their rows; the df of a heavy one comes from the lexicon, and its blocks are cut by a hash of the document."""
    heavy = broadcast(lexicon.where("slices > 1").select("term", "slices", F.col("df").alias("all")))
    known = blocks.join(heavy, "term", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    cut = F.filter("docs", lambda d: F.pmod(F.xxhash64(d["doc_id"]), F.col("slices")) == F.col("slice"))
    placed = known.withColumn("docs", F.when(F.col("slices") > 1, cut).otherwise(F.col("docs"))).where("size(docs) > 0").repartition(buckets, "term", "slice")
    here = F.sum(F.size("docs")).over(Window.partitionBy("term", "slice"))
    return (placed.withColumn("df", F.coalesce("all", here))
            .select("term", "slice", "df", F.inline("docs")).select("term", "slice", "doc_id", "n_psg", "dl", "tf", "hits", "df"))


def with_lexicon(weights: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Query-side rows (…, term) with the term's counts, one row for each slice of the term: the join key of postings."""
    return (weights.join(lexicon.select("term", "df", "dfs", "slices"), "term")
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices"))
