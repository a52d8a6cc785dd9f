from segrank.operators import cohorts as C
from segrank.operators import segments as S


def test_long_is_anti_join(spark):
    dl = spark.createDataFrame([("s", 2), ("l", 5)], "doc_id string, n_psg int")
    short = C.short_docs(dl)
    qrels = spark.createDataFrame([("q", "s", 1), ("q", "l", 1), ("q", "absent", 1)], "qid string, doc_id string, rel int")
    assert {r.doc_id for r in C.split_by_docs(qrels, short, "short").collect()} == {"s"}
    assert {r.doc_id for r in C.split_by_docs(qrels, short, "long").collect()} == {"l", "absent"}


def test_triplet_cleaning_and_split(spark):
    dl = spark.createDataFrame([("s1", 1), ("s2", 2), ("l1", 4)], "doc_id string, n_psg int")
    short = C.short_docs(dl)
    t = spark.createDataFrame([("q", "s1", "s1"), ("q", "s1", "s2"), ("q", "s1", "l1")], "qid string, pos_id string, neg_id string")
    cl = C.clean_triplets(t)
    assert cl.count() == 2
    tagged = {(r.pos_id, r.neg_id): r.cohort for r in C.tag_triplets(cl, short).collect()}
    assert tagged == {("s1", "s2"): "short", ("s1", "l1"): None}
    assert C.tagged_report(C.tag_triplets(cl, short)).first().n_short == 1


def test_run_tags(spark):
    short = spark.createDataFrame([("s",)], "doc_id string")
    qrels = spark.createDataFrame([("a", "s", 1), ("b", "l", 1)], "qid string, doc_id string, rel int")
    run = spark.createDataFrame([("a", "s", 1), ("a", "l", 2), ("b", "s", 1), ("b", "absent", 2), ("c", "s", 1)], "qid string, doc_id string, rank int")
    got = {(r.qid, r.doc_id): r.cohort for r in C.tag_run(run, qrels, short).collect()}
    assert got == {("a", "s"): "short", ("a", "l"): None, ("b", "s"): None, ("b", "absent"): "long", ("c", "s"): None}


def test_distribution_and_threshold(spark):
    dl = spark.createDataFrame([(str(i), n) for i, n in enumerate([1, 1, 2, 3, 3, 3])], "doc_id string, n_psg int")
    d = {r.n_psg: (r.n_docs, r.cum_docs, round(r.cum_share, 4)) for r in C.length_distribution(dl).collect()}
    assert d == {1: (2, 2, 0.3333), 2: (1, 3, 0.5), 3: (3, 6, 1.0)}
    r = C.threshold_report(C.length_distribution(dl)).collect()[0]
    assert (r.max_n_within, r.docs_within, r.docs_beyond) == (2, 3, 3)


def _seg(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, segment int, term string, w int")


def test_ratios_missing_segments_and_empty_first(spark):
    sv = _seg(spark, [("d", 1, "a", 1), ("d", 1, "b", 1), ("d", 3, "a", 1), ("e", 2, "x", 1)])
    ds = spark.createDataFrame([("d", 3), ("e", 2)], "doc_id string, n_seg int")
    r = {(x.doc_id, x.measure, x.others): x.ratio for x in S.term_ratios(sv, ds).collect()}
    # segment 2 of d exists but is empty; segment 4 and 6 are absent -> NULL
    assert r[("d", "shared", "1-2")] == 0.0 and r[("d", "shared", "1-3")] == 0.5
    assert r[("d", "shared", "1-4")] is None
    assert r[("d", "global", "1-2,3")] == 0.0 and r[("d", "unique", "1-2,3")] == 0.5
    assert r[("d", "global", "1-2,3,4,6")] == 0.0
    assert not any(k[0] == "e" for k in r)   # empty segment 1 -> no row


def test_region_shares_per_query_document(spark):
    m = spark.createDataFrame([("q1", "d", 1, "a", 2, 1), ("q1", "d", 2, "a", 1, 1), ("q1", "d", 1, "b", 1, 2),
                               ("q2", "d", 1, "b", 1, 1), ("q2", "d", 2, "b", 1, 1), ("q2", "d", 3, "b", 1, 1)],
                              "qid string, doc_id string, segment int, term string, w int, qtf int")
    got = {r.qid: (r.only_first, r.intersection, r.global_term) for r in S.region_shares(m).collect()}
    assert got["q1"] == (50.0, 50.0, 0.0)
    assert got["q2"] == (0.0, 0.0, 100.0)


def test_best_segments(spark):
    run = spark.createDataFrame([("q", "d", 1, 1, 5.0), ("q", "d", 3, 2, 7.0), ("q", "e", 2, 3, 1.0)],
                                "qid string, doc_id string, segment int, rank int, score double")
    b = {r.doc_id: r for r in S.best_segments(run).collect()}
    assert (b["d"].max_segment, b["d"].second_segment, b["d"].diff) == (3, 1, 2.0)
    assert b["e"].second_segment is None and b["e"].diff is None


def test_first_segments_leave_other_documents_where_they_are(spark):
    from segrank.operators import segments as S
    vec = spark.createDataFrame([("a", 1, "x", 1), ("a", 4, "x", 1), ("b", 1, "x", 1), ("c", 2, "y", 1), ("a", 1, "x", 1)], "doc_id string, segment int, term string, w int")
    size = spark.createDataFrame([("a", 4), ("b", 3), ("c", 2), (None, 5), ("a", 4)], "doc_id string, n_seg int")
    judged = spark.createDataFrame([("q", "a", 1), ("r", "a", 2), ("q", "c", 1), ("q", None, 1)], "qid string, doc_id string, rel int")
    got = S.first_three_segments(vec, size, judged)
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x", 1)] * 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
