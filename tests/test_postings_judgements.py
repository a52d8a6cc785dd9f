"""Postings counted in stretches, and judgements found by numbered runs of words: against plain Python."""

import random
from collections import Counter

import pyarrow.parquet as pq
import pyarrow as pa

from segrank.operators import postings
from segrank.plans.derived import Tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_document_postings_against_counts(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(d, [[rng.choice("abcé") for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(0, 4))]) for d in ["1", "2", "2", None, "3", "4"]]
    docs += [("long", [["x"] * 3000, [], ["y", "x"]]), ("none", [])]
    forward = postings.forward_rows(spark.createDataFrame(docs, "doc_id string, psgs array<array<string>>").coalesce(1))
    want = Counter()
    for d, psgs in docs:
        for term in {t for p in psgs for t in p}:
            hits = tuple((k, p.count(term)) for k, p in enumerate(psgs) if term in p)
            want[d, len(psgs), sum(map(len, psgs)), term, sum(h[1] for h in hits), hits] += 1
    for most in (postings.TOKENS_AT_ONCE, 4):
        monkeypatch.setattr(postings, "TOKENS_AT_ONCE", most)
        found = postings.document_postings(forward)
        assert Counter((r.doc_id, r.n_psg, r.dl, r.term, r.tf, tuple(map(tuple, r.hits))) for r in found.collect()) == want
    assert "array_sort" not in _plan(found) and "Exchange" not in _plan(found)


def test_judgements_make_no_row_for_a_gram(spark, tmpdir_path):
    assert "Generate" not in _plan(Tables(spark, SF)._qrels())
    docs = [(1, "zero One two three four five six"), (2, "one two three"), (3, None), (4, "x one two. three four fives"), (4, "none two three four five"),
            (5, "One two three four five")]
    items = [(10, "ne two three four fiv"), (11, "o three f"), (11, "e two t"), (12, "two"), (None, "one two three")]
    for name, cols in (("documents", {"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]}),
                       ("benchmark", {"item_id": [d for d, _ in items], "text": [t for _, t in items]}), ("labels", {"doc_id": [1], "quality": [1]})):
        pq.write_table(pa.table(cols), f"{tmpdir_path}/{name}.parquet")
    got = sorted(tuple(r) for r in Tables(spark, tmpdir_path).qrels.select("qid", "doc_id").collect() if r[0] is not None)
    by_id = {q: [t for i, t in items if i == q] for q, _ in items if q is not None}
    assert got == sorted((str(q), str(d)) for q, texts in by_id.items() for d, t in docs for x in texts if t is not None and x in t)
