"""The scorer of retrieval: brute force, ties, several passes, items that cross batches, and no row for a (query, document) pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from segrank.operators import retrieve as R
from segrank.operators import topk
from segrank.plans.derived import Tables


@pytest.mark.parametrize("entries, batch, grid", [(500, 10_000, 2_000_000), (7, 3, 5)])
def test_best_agrees_with_brute_force(spark, monkeypatch, entries, batch, grid):
    monkeypatch.setattr(topk, "GRID_CELLS", grid)
    rng = random.Random(3)
    queries = [(q, t, [float(rng.randint(1, 3)), 0.5]) for q in ("a", "b", None, "d") for t in rng.sample("uvwxyz", 3)]
    docs = [(rng.choice([None, *map(str, range(40))]), t, float(rng.randint(1, 2)), rng.choice([None, 1.25])) for t in "uvwxyz" for _ in range(30)]
    side = spark.createDataFrame(queries, "qid string, term string, ws array<double>")
    rows = spark.createDataFrame(docs, "doc_id string, term string, x double, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = topk.best(side, lambda known: rows.join(known, "term"), [F.col("x"), F.col("y")], 4, ["term"], entries=entries)
        got = {tuple(r) for r in R.top_k(found, 4, ["variant", "qid"]).select("variant", "qid", "doc_id", "rank", "score").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sums: dict = {}
    for q, t, ws in queries:
        for d, u, x, y in docs:
            for v, value in enumerate((x, y)):
                if u == t and value is not None:
                    sums[v, q, d] = sums.get((v, q, d), 0.0) + ws[v] * value
    want = set()
    for v, q in {k[:2] for k in sums}:
        mine = sorted(((-s, d is not None, d or "") for (v2, q2, d), s in sums.items() if (v2, q2) == (v, q)))[:4]
        want |= {(v, q, d if there else None, k + 1, -s) for k, (s, there, d) in enumerate(mine)}
    assert got == want


def test_runs_exchange_no_pairs_of_query_and_document(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for run in (R.retrieve_first(t.postings, t.query_impacts, t.lexicon, t.weight, 4), R.bm25(t, t.query_tokens), R.bm25(t, t.query_tokens, 100, [1, 2]),
                R.retrieve_passages_first(t.postings, t.query_impacts, t.lexicon, t.weight), R.sdm_bm25(t, t.query_tokens),
                R.vector_sweep(t.postings, t.query_impacts, t.lexicon, t.weight, [1, 2])):
        plan = run._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\(qid#\d+, doc_id", plan)


def test_documents_stay_together_behind_a_join(spark):
    """The sweeps join the lengths on doc_id; the dealing by document must not be planned away."""
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = R.bm25(t, t.query_tokens, 100, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
