"""What is counted where the documents are: lexicon, posting blocks, pairs of terms, and the scorer's sums and selection."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from segrank.operators import postings, topk
from segrank.operators import vectors as V


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _forward(spark):
    rng = random.Random(11)
    docs = [(d, [[rng.choice("abcdé") for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(0, 13))]) for d in ["1", "2", "2", None, "3", "4", "5"]]
    docs += [("none", []), ("empty", [[], []])]
    return docs, postings.forward_rows(spark.createDataFrame(docs, "doc_id string, psgs array<array<string>>").repartition(2))


def test_lexicon_exchanges_counts_of_stretches(spark):
    docs, forward = _forward(spark)
    lexicon = postings.lexicon_rows(forward)
    assert "hits" not in _plan(lexicon)
    want = {}
    for _, psgs in docs:
        for term in {t for p in psgs for t in p}:
            row = want.setdefault(term, [0, 0, [0] * 10])
            first = next(k for k, p in enumerate(psgs) if term in p)
            row[0] += 1
            row[1] += sum(p.count(term) for p in psgs)
            row[2] = [x + (first < n) for n, x in enumerate(row[2], 1)]
    assert {r.term: [r.df, r.cf, r.dfs] for r in lexicon.collect()} == want


def test_posting_blocks_are_dealt_and_hold_the_same_rows(spark):
    docs, forward = _forward(spark)
    blocks = postings.posting_blocks(forward)
    assert blocks.count() <= 2 * 5                       # a row a term and task
    columns = ["term", "doc_id", "n_psg", "dl", "tf", "hits"]
    want = Counter(map(repr, postings.document_postings(forward).select(columns).collect()))
    for slice_rows in (postings.SLICE_ROWS, 1):
        lexicon = postings.lexicon_rows(forward, slice_rows=slice_rows)
        found = postings.sliced(blocks, lexicon, F.broadcast, 3)
        assert Counter(map(repr, found.select(columns).collect())) == want
        df = {r.term: r.df for r in lexicon.collect()}
        rows = found.select("term", "df", "slice", "doc_id").collect()
        assert all(r.df == df[r.term] for r in rows) and (max(r.slice for r in rows) > 0) == (slice_rows == 1)
        assert len({(r.term, r.doc_id) for r in rows}) == len({(r.term, r.doc_id, r.slice) for r in rows})


def test_pairs_make_no_row_for_a_position(spark):
    docs, forward = _forward(spark)
    found = V.window_pair_counts(forward, 3)
    assert "Generate" not in _plan(found)[_plan(found).index("Exchange"):]
    want = Counter()
    for _, psgs in docs:
        for p in psgs:
            for i, a in enumerate(p):
                for b in p[i + 1:i + 4]:
                    if a != b:
                        want[a, b] += 1
                        want[b, a] += 1
    assert {(r.src_term, r.term): r.c for r in found.collect()} == dict(want)


def test_cut_keeps_the_first_of_equal_scores():
    rng = np.random.default_rng(2)
    best, rows = topk.Best(5, 7), []
    for part in range(6):
        key, score = rng.integers(0, 5, 40), rng.integers(0, 9, 40).astype(float)
        item = part * 40 + np.arange(40)
        best.add(key, score, item)
        rows += list(zip(key.tolist(), score.tolist(), item.tolist()))
        if part % 2:
            kept = best.cut()
    want = {x for k in range(5) for x in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:7]}
    assert set(zip(*(c.tolist() for c in kept))) == want and len(kept[0]) == len(want)


def test_sums_of_dense_and_laid_out_terms():
    rng = np.random.default_rng(4)
    of = np.sort(np.r_[np.repeat([0, 2], 6), rng.integers(0, 5, 9)])
    query, weight = rng.integers(0, 6, len(of)), rng.integers(-2, 4, (len(of), 2)).astype(float)
    weight[3, 1] = np.nan
    no, item = rng.integers(0, 5, 30), np.sort(rng.integers(0, 4, 30))
    values = [rng.integers(0, 3, 30).astype(float), np.where(rng.random(30) < 0.3, np.nan, 1.5)]
    products = topk.Products(of, query, weight, 6)
    assert 0 < products.width < 5
    sums, seen = products.sums(item, no, values, 4)
    want, there = np.zeros((2, 4, 6)), np.zeros((2, 4, 6), bool)
    for v in range(2):
        for i, n, x in zip(item, no, values[v]):
            for t, q, w in zip(of, query, weight[:, v]):
                if t == n and not np.isnan(x * w):
                    want[v, i, q] += x * w
                    there[v, i, q] = True
    assert np.allclose(sums, want) and (seen == there).all()
