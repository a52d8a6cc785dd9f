"""Group-by SDM features against a dense re-computation of the tensor
formulation (shifted sums, max over document positions, sum over query
positions) on random small cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from segrank.operators import sdm as K


def _dense(q, wq, d, s, windows, prox, exact):
    ql, dl = len(q) + 2, len(d) + 2
    M = np.zeros((ql, dl))
    for i, qt in enumerate(q):
        for j, dt in enumerate(d):
            M[i + 1, j + 1] = wq[i] * math.log1p(max(s.get((dt, qt), 0.0), 0.0))
    E = np.zeros_like(M)
    for i, qt in enumerate(q):
        for j, dt in enumerate(d):
            if dt == qt:
                E[i + 1, j + 1] = M[i + 1, j + 1]
    X = E if exact else M
    feats = {"O_1": M.max(axis=1).sum()}
    for n in windows[1:]:
        if ql < n or dl < n:
            feats[f"O_{n}"] = 0.0
            continue
        best = []
        for a in range(ql - n + 1):
            vals = []
            for b in range(dl - n + 1):
                cells = [X[a + k, b + k] for k in range(n)]
                if exact and not all(c > 0 for c in cells):
                    vals.append(0.0)
                else:
                    vals.append(sum(cells))
            best.append(max(vals))
        feats[f"O_{n}"] = sum(best)
    if dl < prox:
        P = None
    else:
        P = np.array([[X[i, b:b + prox].max() for b in range(dl - prox + 1)] for i in range(ql)])
    for n in windows[1:]:
        key = f"U_{n}_p_{prox}"
        if P is None or ql < n:
            feats[key] = 0.0
            continue
        best = []
        for a in range(ql - n + 1):
            vals = []
            for b in range(P.shape[1]):
                cells = [P[a + k, b] for k in range(n)]
                if exact and not all(c > 0 for c in cells):
                    vals.append(0.0)
                else:
                    vals.append(sum(cells))
            best.append(max(vals))
        feats[key] = sum(best)
    return feats


def test_features_match_dense_formulation(spark):
    rnd = random.Random(7)
    vocab = ["a", "b", "c", "d"]
    s = {(t, t): 1.0 for t in vocab}
    for x in vocab:
        for y in vocab:
            if x != y and rnd.random() < 0.4:
                s[(x, y)] = round(rnd.uniform(0.1, 0.9), 3)
    wts = {t: round(rnd.uniform(0.2, 2.0), 3) for t in vocab}
    cases = []
    for c in range(40):
        q = [rnd.choice(vocab) for _ in range(rnd.randint(1, 4))]
        d = [rnd.choice(vocab) for _ in range(rnd.randint(1, 12))]
        cases.append((f"q{c}", q, f"d{c}", d))
    qrows = [(qid, i + 1, t, wts[t], len(q) + 2) for qid, q, _, _ in cases for i, t in enumerate(q)]
    qs = spark.createDataFrame(qrows, "qid string, i int, term string, wq double, q_len int")
    ds = spark.createDataFrame([(did, 0, d) for _, _, did, d in cases], "doc_id string, psg int, terms array<string>")
    exp = spark.createDataFrame([(a, b, v) for (a, b), v in s.items()], "src_term string, term string, s double")
    pairs = spark.createDataFrame([(qid, did) for qid, _, did, _ in cases], "qid string, doc_id string")
    rows = K.match_rows(pairs, ds, K.query_expansion(qs, exp), 1).cache()
    for cfg in (K.SdmConfig(True, (1, 2), 3), K.SdmConfig(False, (1, 3), 4), K.SdmConfig(True, (1, 5), 10)):
        got = {(r.qid, r.feature): r.value for r in
               K.pooled_features(K.passage_features(rows, cfg), pairs, cfg).collect()}
        for qid, q, did, d in cases:
            want = _dense(q, [wts[t] for t in q], d, s, cfg.windows, cfg.proximity, cfg.exact)
            for f in cfg.feature_names:
                assert abs(got[(qid, f)] - want[f]) < 1e-9, (cfg, qid, q, d, f, got[(qid, f)], want[f])


def test_exact_features_not_above_soft(spark):
    qs = spark.createDataFrame([("q", 1, "a", 1.0, 4), ("q", 2, "b", 1.0, 4)], "qid string, i int, term string, wq double, q_len int")
    ds = spark.createDataFrame([("d", 0, ["a", "c", "b"])], "doc_id string, psg int, terms array<string>")
    exp = spark.createDataFrame([("a", "a", 1.0), ("b", "b", 1.0), ("c", "c", 1.0), ("c", "b", 0.5)],
                                "src_term string, term string, s double")
    pairs = spark.createDataFrame([("q", "d")], "qid string, doc_id string")
    cfg_e, cfg_s = K.SdmConfig(True, (1, 2), 3), K.SdmConfig(False, (1, 2), 3)
    rows = K.match_rows(pairs, ds, K.query_expansion(qs, exp), 1)
    e = {r.feature: r.value for r in K.pooled_features(K.passage_features(rows, cfg_e), pairs, cfg_e).collect()}
    s_ = {r.feature: r.value for r in K.pooled_features(K.passage_features(rows, cfg_s), pairs, cfg_s).collect()}
    assert all(e[f] <= s_[f] + 1e-12 for f in cfg_e.feature_names)
    # "a b" is not adjacent in the document -> exact ordered bigram is 0;
    # soft: windows starting at query slots 0, 1, 2 score ln 2, ln 2 + ln 1.5, ln 2
    assert e["O_2"] == 0.0 and abs(s_["O_2"] - (3 * math.log(2) + math.log(1.5))) < 1e-9


def test_missing_passages_give_zero_features(spark):
    pairs = spark.createDataFrame([("q", "nodoc")], "qid string, doc_id string")
    empty = spark.createDataFrame([], "qid string, doc_id string, psg int, feature string, value double")
    cfg = K.SdmConfig()
    got = K.pooled_features(empty, pairs, cfg).collect()
    assert sorted(r.feature for r in got) == sorted(cfg.feature_names)
    assert all(r.value == 0.0 for r in got)


def test_long_passages_are_laid_out_in_blocks():
    rnd = np.random.default_rng(5)
    for _ in range(40):
        q_len, d_len, cells = int(rnd.integers(3, 8)), int(rnd.integers(3, 60)), int(rnd.integers(1, 80))
        at = np.unique(rnd.integers(0, q_len * d_len, cells))
        i, j, m, same = at // d_len, at % d_len, rnd.random(len(at)) + 0.1, rnd.random(len(at)) < 0.6
        for shape in (K.Shape(True, (1, 2), 3), K.Shape(False, (1, 3), 5)):
            want = K.matrix_features(q_len, d_len, i, j, m, same, shape)
            for block in (1, 2, 7, 30):
                got = K.matrix_features(q_len, d_len, i, j, m, same, shape, block)
                assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)


def _fit_case(spark, signal):
    rnd = random.Random(1)
    feats, trip = [], []
    for k in range(60):
        q = f"q{k}"
        up = 1.0 if rnd.random() < signal else -1.0
        feats += [(q, f"p{k}", "O_1", 2.0 + up * rnd.random()), (q, f"p{k}", "O_2", rnd.random()),
                  (q, f"n{k}", "O_1", 2.0 + rnd.random() * 0.3), (q, f"n{k}", "O_2", rnd.random())]
        trip.append((q, f"p{k}", f"n{k}"))
    f = spark.createDataFrame(feats, "qid string, doc_id string, feature string, value double")
    return feats, K.feature_differences(f, spark.createDataFrame(trip, "qid string, pos_id string, neg_id string"), ["O_1", "O_2"])


def test_fit_weights_is_stationary_and_logged(spark):
    feats, diffs = _fit_case(spark, 0.8)
    w, log = K.fit_fusion_weights(diffs.cache(), ["O_1", "O_2"])
    v = {(q, d, f): x for q, d, f, x in feats}
    d = np.array([[v[f"q{k}", f"p{k}", f] - v[f"q{k}", f"n{k}", f] for f in ("O_1", "O_2")] for k in range(60)])
    x = np.array([w["O_1"], w["O_2"]])
    p = 1 / (1 + np.exp(d @ x))
    assert np.abs(-(p[:, None] * d).mean(axis=0) + 1e-3 * x).max() < 1e-8 and w["O_1"] > 0
    losses = [val for _, name, val in log if name == "loss"]
    assert abs(losses[0] - math.log(2)) < 1e-12 and losses[-1] < losses[0]
    assert {name for _, name, _ in log} == {"loss", "O_1", "O_2"} and len(log) == 3 * len(losses)


def test_fit_weights_of_separable_and_empty_input(spark):
    _, diffs = _fit_case(spark, 1.0)
    w, _ = K.fit_fusion_weights(diffs, ["O_1", "O_2"])
    assert w["O_1"] > 0 and all(math.isfinite(x) for x in w.values())
    assert K.fit_fusion_weights(diffs.limit(0), ["O_1", "O_2"])[0] == {"O_1": 0.0, "O_2": 0.0}


def test_expansion_is_read_for_the_terms_of_the_candidates_only(spark):
    exp = spark.createDataFrame([("a", "a", 1.0), ("b", "a", 0.5), ("c", "a", 0.25), ("b", "b", 1.0), ("a", "b", 0.5), ("c", "z", 0.5), ("b", "d", -1.0)],
                                "src_term string, term string, s double")
    tokens = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 2, "a"), ("r", 0, "a"), ("r", 1, "d"), ("s", 0, "new")], "qid string, pos int, term string")
    slots = K.query_slots(tokens, spark.createDataFrame([("a", 1.0), ("b", 2.0), ("d", 1.5)], "term string, scale double"))
    psgs = spark.createDataFrame([("1", 0, ["b", "b", "x"]), ("1", 1, ["a"]), ("1", 2, ["c"]), ("2", 0, ["c", "a"])], "doc_id string, psg int, terms array<string>")
    pairs = spark.createDataFrame([("q", "1"), ("r", "2"), ("q", "9"), ("q", "1")], "qid string, doc_id string")
    wanted = K.candidate_terms(pairs, psgs, 2)
    assert sorted(map(tuple, wanted.collect())) == [("q", "a"), ("q", "b"), ("q", "x"), ("r", "a"), ("r", "c")]
    rows = lambda df: sorted((r.qid, r.q_len, r.term, sorted(map(tuple, r.cells))) for r in df.collect())
    whole = K.query_expansion(slots, exp)
    assert rows(K.expansion_of(wanted, slots, exp)) == rows(whole.join(wanted, ["qid", "term"], "left_semi"))
    assert whole.count() > K.expansion_of(wanted, slots, exp).count() == 4
