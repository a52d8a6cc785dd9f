import math

from pyspark.sql import functions as F

from segrank.functions.numeric import quantise
from segrank.operators import aggregate as A
from segrank.operators import vectors as V


def test_quantise_float32_truncation(spark):
    df = spark.createDataFrame([(0.29,), (0.128,), (0.009,), (-0.5,)], "x double")
    got = [r.q for r in df.select(quantise(F.col("x")).alias("q")).collect()]
    assert got == [29, 12, 0, -50]


def test_reduce_duplicates(spark):
    df = spark.createDataFrame([("q", "a", 3), ("q", "a", 4), ("d", "b", -2)], "id string, term string, w int")
    s = {(r.id, r.term): r.w for r in V.reduce_duplicates(df, ["id"], "sum").collect()}
    m = {(r.id, r.term): r.w for r in V.reduce_duplicates(df, ["id"], "amax").collect()}
    assert s == {("q", "a"): 7, ("d", "b"): -2}
    assert m == {("q", "a"): 4, ("d", "b"): 0}


def test_abs_pooling_first_position_wins(spark):
    df = spark.createDataFrame([("d", 0, "a", -3.0), ("d", 1, "a", 2.0), ("d", 2, "b", 1.0), ("d", 3, "b", -1.0)],
                               "doc_id string, pos int, term string, v double")
    got = {r.term: r.v for r in V.pool_positions(df, ["doc_id"], "abs").collect()}
    assert got == {"a": -3.0, "b": 1.0}


def _impacts(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, psg int, n_psg int, term string, w int")


def test_modes_on_term_in_one_of_three_passages(spark):
    imp = _impacts(spark, [("d", 0, 3, "t", 100), ("d", 1, 3, "u", 5), ("d", 2, 3, "u", 5)])
    got = {m: {r.term: r.w for r in A.aggregate_passages(imp, m, 3).collect()} for m in A.MODES}
    assert abs(got["mean"]["t"] - 100 / 3) < 1e-12
    assert got["max"]["t"] == 100 and got["sum"]["t"] == 100 and got["gmean"]["t"] == 100
    assert got["first"] == {"t": 100.0}
    # exp: log1p(expm1(100) / 3), ceil
    assert got["exp"]["t"] == math.ceil(math.log1p(math.expm1(100) / 3))


def test_exp_is_overflow_safe(spark):
    imp = _impacts(spark, [("d", 0, 2, "t", 800), ("d", 1, 2, "t", 800)])
    r = A.aggregate_passages(imp, "exp", 2).collect()[0]
    assert r.w == 800.0


def test_sweep_matches_single_runs(spark):
    rows = [("d", p, 4, t, w) for p, t, w in [(0, "a", 3), (1, "a", 5), (1, "b", 2), (2, "c", 7), (3, "a", 1)]]
    imp = _impacts(spark, rows)
    sw = A.aggregate_sweep(imp, 4)
    for n in range(1, 5):
        for m in ("max", "sum", "mean"):
            one = {r.term: r.w for r in A.aggregate_passages(imp, m, n).collect()}
            two = {r.term: r.w for r in sw.filter((F.col("n") == n) & (F.col("mode") == m)).collect()}
            assert one == two


def test_dots_and_vocab_index(spark):
    q = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "qid string, term string, qw int")
    d = spark.createDataFrame([("x", "a", 3.0), ("y", "c", 1.0)], "doc_id string, term string, w double")
    pairs = spark.createDataFrame([("q", "x"), ("q", "y")], "qid string, doc_id string")
    got = {r.doc_id: r.dot for r in V.rowwise_dot(q, d, pairs).collect()}
    assert got == {"x": 6, "y": 0}
    assert V.all_pairs_dot(q, d).count() == 1
    voc = spark.createDataFrame([(t,) for t in "delta alpha charlie bravo echo".split()], "term string")
    idx = {r.term: r.idx for r in V.vocabulary_index(voc).collect()}
    assert idx == {"alpha": 0, "bravo": 1, "charlie": 2, "delta": 3, "echo": 4}


def test_expansion_leaves_nothing_out(spark):
    docs = [(str(k), [["hub", f"t{k}", "hub", f"rare{k}"]]) for k in range(8)]
    forward = spark.createDataFrame(docs, "doc_id string, psgs array<array<string>>")
    cf = {"hub": 16, **{f"t{k}": 1 for k in range(8)}, **{f"rare{k}": 1 for k in range(8)}}
    lexicon = spark.createDataFrame(list(cf.items()), "term string, cf long")
    got = {(r.src_term, r.term): r.s for r in V.dice_expansion(V.window_pair_counts(forward), lexicon).collect()}
    want = {(t, t): 1.0 for t in cf}
    for k in range(8):
        for a, b, c in (("hub", f"t{k}", 2), ("hub", f"rare{k}", 1), (f"t{k}", f"rare{k}", 1)):
            want[a, b] = want[b, a] = 2.0 * c / (cf[a] + cf[b])
    assert got == want


def _brute_expansion(texts, table):
    import math
    out = {}
    for key, terms in texts.items():
        for t in set(terms):
            for (a, b), s in table.items():
                if a == t:
                    out[key, b] = max(out.get((key, b), 0.0), math.log1p(max(s, 0.0)))
    # E10 multiplies in float32
    import numpy as np
    return {k: w for k, v in out.items() if (w := int(np.float32(v) * np.float32(100)))}


def test_expansion_product_and_gate(spark):
    import random
    r = random.Random(4)
    vocab = [f"t{k}" for k in range(12)]
    table = {(t, t): 1.0 for t in vocab[:10]}
    for _ in range(60):
        table[r.choice(vocab), r.choice(vocab)] = r.choice([0.001, 0.009, 0.0101, 0.3, 1.4, -0.5])
    texts = {f"d{k}": [r.choice(vocab) for _ in range(r.randint(1, 6))] for k in range(15)}
    exp = spark.createDataFrame([(a, b, s) for (a, b), s in table.items()], "src_term string, term string, s double")
    terms = spark.createDataFrame([(d, t) for d, ts in texts.items() for t in sorted(set(ts))], "doc_id string, term string")
    want = _brute_expansion(texts, table)
    assert {(x.doc_id, x.term): x.w for x in V.expansion_encoder(terms, ["doc_id"], exp).collect()} == want
    gated = {k: w for k, w in want.items() if k[1] in texts[k[0]]}
    assert {(x.doc_id, x.term): x.w for x in V.gated_expansion(terms, ["doc_id"], exp).collect()} == gated


def test_rowwise_dots_with_equal_entries(spark):
    import random
    r = random.Random(9)
    first = [(f"q{k % 3}", r.choice("abcd"), r.choice([-2, 1, 3])) for k in range(20)]
    second = [(f"x{k % 4}", r.choice("abce"), r.choice([-1, 2, 5])) for k in range(25)]
    pairs = [(f"q{i}", f"x{j}") for i in range(4) for j in range(5)]
    want = {}
    for a, b in pairs:
        mine = [(t, w) for x, t, w in second if x == b]
        want[a, b] = sum(max([w * v for t2, v in mine if t2 == t] + [0]) for x, t, w in first if x == a)
    f = spark.createDataFrame(first, "qid string, term string, qw int")
    s = spark.createDataFrame(second, "doc_id string, term string, w int")
    p = spark.createDataFrame(pairs + pairs[:3], "qid string, doc_id string")
    assert {(x.qid, x.doc_id): x.dot for x in V.rowwise_dot(f, s, p).collect()} == want
    # with weights of 0 or more the dense forms agree
    f, s = f.where("qw > 0"), s.where("w > 0")
    want = {(x.qid, x.doc_id): x.dot for x in V.rowwise_dot(f, s, p).collect()}
    index = spark.createDataFrame([(t, k) for k, t in enumerate("abcde")], "term string, idx long")
    dense = V.to_dense(V.reduce_duplicates(s, ["doc_id"], "amax"), "doc_id", index, 5)
    assert {(x.qid, x.doc_id): x.dot for x in V.sparse_dense_dot(f, dense, p, index).collect()} == want
    q = V.to_dense(V.reduce_duplicates(f, ["qid"], "sum", "qw"), "qid", index, 5, "qw")
    assert {(x.qid, x.doc_id): x.dot for x in V.dense_dot(q, dense, p).collect()} == want


def test_special_slots_have_no_weight(spark):
    from segrank.operators import segment as T
    slots = T.with_boundary_slots(spark.createDataFrame([("d", 0, ["a", "b", "a"]), ("d", 1, [])], "doc_id string, psg int, terms array<string>"))
    rows = sorted((r.psg, r.pos, r.term, r.special) for r in slots.collect())
    assert rows == [(0, 0, "[CLS]", True), (0, 1, "a", False), (0, 2, "b", False), (0, 3, "a", False), (0, 4, "[SEP]", True),
                    (1, 0, "[CLS]", True), (1, 1, "[SEP]", True)]
    keys = ["doc_id", "psg"]
    scored = slots.withColumn("s", F.lit(2.0))
    weights = spark.createDataFrame([(t, 1.0) for t in ("a", "b", "[CLS]", "[SEP]")], "term string, scale double")
    for vec in (V.binary_encoder(slots, keys), V.scaled_encoder(slots, keys, weights), V.token_weight_encoder(scored, keys),
                V.epic_encoder(scored, keys)):
        assert sorted(r.term for r in vec.collect()) == ["a", "b"]


def test_block_top_dots(spark, monkeypatch):
    import random
    r = random.Random(3)
    first = [(f"q{k}", t, r.randint(1, 4)) for k in range(5) for t in r.sample("abcdefgh", 3)]
    second = [(f"x{k}", t, r.randint(0, 3)) for k in range(60) for t in r.sample("abcdefghij", 4)]
    dots = {}
    for a, t, x in first:
        for b, u, w in second:
            if t == u:
                dots[a, b] = dots.get((a, b), 0) + x * w
    want = sorted((a, b, d, k) for a in {x[0] for x in first}
                  for k, (d, b) in enumerate(sorted(((d, b) for (c, b), d in dots.items() if c == a), key=lambda x: (-x[0], x[1]))[:7], 1))
    f = spark.createDataFrame(first, "qid string, term string, qw int")
    s = spark.createDataFrame(second, "doc_id string, term string, w int")
    for entries in (1000, 4):
        assert sorted(tuple(x) for x in V.block_top_dots(f, s, 7, entries=entries).collect()) == want
    assert V.block_top_dots(f.limit(0), s, 7).count() == 0


def test_sweep_summary_exchanges_an_entry_once(spark):
    from segrank.plans.catalog import build_all
    plan = build_all()["a7_sweep_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange") == 2      # the other: a row a (mode, n)
    imp = spark.createDataFrame([("d", 0, 3, "x", 2), ("d", 0, 3, "x", 4), ("d", 2, 3, "x", -9), ("e", 3, 4, "y", 5), (None, 1, 2, "x", 1)],
                                "doc_id string, psg int, n_psg int, term string, w int")
    got = {(r.mode, r.n, r.doc_id): r.w for r in A.aggregate_sweep(imp, 4).collect()}
    assert got["max", 1, "d"] == 4.0 and got["sum", 3, "d"] == -3.0 and got["mean", 3, "d"] == -1.0 and got["mean", 2, "d"] == 3.0
    assert ("max", 3, "e") not in got and got["sum", 4, "e"] == 5.0 and got["max", 4, None] == 1.0 and ("sum", 1, None) not in got


def test_dense_rows_are_laid_out_in_linear_work(spark, monkeypatch):
    monkeypatch.setattr(V, "DENSE_CELLS", 7)
    vec = spark.createDataFrame([("a", "t2", 5), ("a", "t0", -1), ("b", "t1", 2), (None, "t1", 3), ("c", "zz", 1)], "doc_id string, term string, w int")
    index = spark.createDataFrame([("t0", 0), ("t1", 1), ("t2", 2)], "term string, idx long")
    dense = V.to_dense(vec, "doc_id", index, 3)
    assert {r.doc_id: r.dense for r in dense.collect()} == {"a": [-1.0, 0.0, 5.0], "b": [0.0, 2.0, 0.0], None: [0.0, 3.0, 0.0]}
    assert "element_at" not in dense._jdf.queryExecution().optimizedPlan().toString()


def test_expansion_vectors_reduce_in_the_row(spark):
    """E4 in the array layout: a row a text whose texts may go on in the next batch, with null and repeated keys; no cell is exchanged."""
    exp = spark.createDataFrame([("a", "a", 1.0), ("b", "b", 1.0), ("c", "c", 1.0), ("a", "b", 0.9), ("b", "c", 0.4), ("c", "a", 0.001)],
                                "src_term string, term string, s double")
    texts = {("d1", 0): "abc", ("d1", 1): "a", (None, 0): "bc", ("d2", 7): "cz", ("d3", 0): "z"}
    terms = spark.createDataFrame([(d, p, t) for (d, p), ts in texts.items() for t in ts + ts], "doc_id string, psg int, term string")
    index = V.vocabulary_index(V.vocabulary(exp))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        vectors = V.expansion_vectors(terms, ["doc_id", "psg"], exp, index)
        got = {(r.doc_id, r.psg): dict(zip(r.idx, r.w)) for r in vectors.collect()}
        count = vectors.count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert count == len(got) == 4
    assert got == {("d1", 0): {0: 69, 1: 69, 2: 69}, ("d1", 1): {0: 69, 1: 64}, (None, 0): {1: 69, 2: 69}, ("d2", 7): {2: 69}}
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "idx" in plan and "hashpartitioning(doc_id" not in plan
