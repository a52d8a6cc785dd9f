"""What a task holds and what is exchanged stays bounded: lower bounds of the scorer, triplets' texts, pair counts, dot products."""

import random

import pytest
from pyspark.sql import functions as F

from segrank.operators import retrieve as R
from segrank.operators import sdm as K
from segrank.operators import topk


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lower_bounds_leave_the_best_and_drop_most_of_the_rest(spark, monkeypatch):
    rng = random.Random(5)
    side = spark.createDataFrame([(q, t, [float(rng.randint(1, 3)), 1.0]) for q in ("a", "b", None) for t in "uvwx"], "qid string, term string, ws array<double>")
    docs = spark.createDataFrame([(None if i == 7 else f"d{i}", t, rng.random(), rng.choice([None, float(rng.randint(1, 2))]))
                                  for i in range(3000) for t in rng.sample("uvwx", 2)], "doc_id string, term string, x double, y double").cache()
    run = lambda: topk.best(side, lambda known: docs.join(known, "term"), [F.col("x"), F.col("y")], 40, ["term"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # eight tasks, as with more rows
    every = run()
    want, passed = rows(R.top_k(every, 40, ["variant", "qid"])), every.count()
    monkeypatch.setattr(topk, "HELD_ROWS", 10)
    assert rows(R.top_k(run(), 40, ["variant", "qid"])) == want
    monkeypatch.setattr(topk, "HELD_ROWS", 239)       # below the 240 best rows of a task: bounds are sought, nothing is passed on early
    found = run()
    assert rows(R.top_k(found, 40, ["variant", "qid"])) == want
    assert len(want) == 240 and found.count() < passed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_triplets_texts_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_DOCS", 3)
    rng = random.Random(2)
    ids = [f"d{i}" for i in range(12)]
    triplets = [(rng.choice(["a", "b", "c", None]), rng.choice([*ids, "x", None]), rng.choice([*ids, "y", None])) for _ in range(150)]
    triplets = spark.createDataFrame(triplets + triplets[:20], "qid string, pos_id string, neg_id string")
    queries = spark.createDataFrame([("a", "qa"), ("b", "qb"), ("b", "other"), ("c", None), (None, "n")], "qid string, text string")
    corpus = spark.createDataFrame([(d, f"text {d}") for d in ids] + [("d1", "again"), (None, "none"), ("d2", None)], "doc_id string, text string")
    d = corpus.select("doc_id", "text")
    want = (triplets.join(queries.select("qid", F.col("text").alias("query")), "qid")
            .join(d.select(F.col("doc_id").alias("pos_id"), F.col("text").alias("pos")), "pos_id")
            .join(d.select(F.col("doc_id").alias("neg_id"), F.col("text").alias("neg")), "neg_id").select("qid", "pos_id", "neg_id", "query", "pos", "neg"))
    found = K.text_triplets(triplets, queries, corpus)
    assert found.columns == want.columns and rows(found) == rows(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(neg_id" in line and "pos#" in line]


def test_only_asked_pairs_are_counted(spark):
    from segrank.operators import vectors as V
    rng = random.Random(4)
    passages = [[[rng.choice("abcdefgh") for _ in range(12)] for _ in range(2)] for _ in range(6)]
    forward = spark.createDataFrame([(p,) for p in passages] + [(None,), ([[]],)], "psgs array<array<string>>")
    sources = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), (None, "h"), ("3", None)], "qid string, term string")
    targets = spark.createDataFrame([("1", "c"), ("2", "d"), (None, "g"), ("3", "a")], "qid string, term string")
    every = {(r.src_term, r.term): r.c for r in V.window_pair_counts(forward).collect()}
    asked = {("a", "c"), ("b", "c"), ("c", "d"), ("h", "g")}
    found = {(r.src_term, r.term): r.c for r in V.window_pair_counts(forward, asked=V.asked_terms(sources, targets)).collect()}
    assert found.items() <= every.items() and {k: every[k] for k in asked if k in every} == {k: found[k] for k in asked if k in found}
    assert asked & every.keys() <= found.keys() <= asked | {(b, a) for a, b in asked}


def test_pairs_of_a_query_are_counted_without_a_row_a_position(spark, monkeypatch):
    from segrank.operators import postings as P
    monkeypatch.setattr(P, "TOKENS_AT_ONCE", 40)
    rng = random.Random(8)
    docs = [(rng.choice([None, "d1", *(f"d{i}" for i in range(2, 9))]), [[rng.choice("abcdxy") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(0, 4))])
            for _ in range(25)]
    forward = P.forward_rows(spark.createDataFrame(docs + [("gone", None)], "doc_id string, psgs array<array<string>>"))
    asked = [("a", "b"), ("b", "a"), ("c", "c"), ("a", "d"), ("a", "missing")]
    pairs = spark.createDataFrame([("q", *p, 1.0) for p in asked] + [("r", "a", "b", 1.0)], "qid string, t1 string, t2 string, qweight double")
    want: dict = {}
    for doc_id, psgs in docs:
        flat = [(t, k) for k, p in enumerate(psgs) for t in p]
        for i, (x, _) in enumerate(flat):
            for d, (z, k) in enumerate(flat[i + 1:i + 5]):
                for t1, t2 in asked:
                    for ahead in (True, False):
                        if (x, z) == ((t1, t2) if ahead else (t2, t1)):
                            c = want.setdefault((doc_id, len(flat), t1, t2), [0, 0, 0, 0])
                            for v, inside in enumerate((True, k < 2)):
                                c[2 * v] += inside and ahead and d == 0
                                c[2 * v + 1] += inside
    found = R.pair_counts(forward, pairs, [None, 2], 5)
    assert rows(found) == sorted(((*k, *c) for k, c in want.items()), key=repr)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert not rows(R.pair_counts(forward, pairs.where("t2 = 'missing'"), [None], 5)) and not rows(R.pair_counts(forward, pairs.limit(0), [None], 5))
