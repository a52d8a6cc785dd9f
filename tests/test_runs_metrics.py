import math

from segrank.operators import metrics as M
from segrank.operators import runs as RU


def test_max_passage_run(spark):
    pr = spark.createDataFrame([("q", "a", 1, 1, 9.0), ("q", "b", 0, 2, 8.0), ("q", "a", 0, 3, 7.0), ("q", "c", 5, 4, 6.0)],
                               "qid string, doc_id string, psg int, rank int, score double")
    got = [(r.doc_id, r.rank, r.src_rank, r.score) for r in RU.max_passage_run(pr, 2).orderBy("rank").collect()]
    assert got == [("a", 1, 1, 9.0), ("b", 2, 2, 8.0)]   # c only has passage 5 >= 2
    got1 = [(r.doc_id, r.score) for r in RU.max_passage_run(pr, 1).orderBy("rank").collect()]
    assert got1 == [("b", 8.0), ("a", 7.0)]


def test_average_rank_ties(spark):
    run = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 2.0), ("q", "d", 1.0)],
                                "qid string, doc_id string, score double")
    got = {r.doc_id: r.avg_rank for r in RU.average_rank(run).collect()}
    assert got == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}


def test_metrics_denominators(spark):
    qrels = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "x", 1), ("q3", "z", 0)],
                                  "qid string, doc_id string, rel int")
    run = spark.createDataFrame([("q1", "c", 3.0), ("q1", "b", 2.0), ("q1", "a", 1.0), ("q9", "a", 1.0)],
                                "qid string, doc_id string, score double")
    pq = {r.qid: r for r in M.per_query(run, qrels).collect()}
    assert set(pq) == {"q1", "q2"}        # q3 has no relevant doc, q9 is unjudged
    assert pq["q1"].rr == 0.5 and pq["q2"].rr == 0.0
    idcg = 2 / math.log2(2) + 1 / math.log2(3)
    dcg = 2 / math.log2(3) + 1 / math.log2(4)
    assert abs(pq["q1"].ndcg - dcg / idcg) < 1e-12
    s = M.summary(run, qrels).collect()[0]
    assert s.n_queries == 2 and s.mrr == 0.25 and s.recall == 0.5


def _tail(t, dof):
    """Two-sided tail of Student's density, by Simpson's rule over x = |t| + u / (1 - u)."""
    if t is None or dof <= 0:
        return None
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)

    def density(u):
        if u == 1:
            return scale * dof if dof == 1 else 0.0
        x = abs(t) + u / (1 - u)
        return scale * (1 + x * x / dof) ** (-(dof + 1) / 2) / (1 - u) ** 2

    n = 20_000
    return 2 * (density(0) + density(1) + sum((4 if k % 2 else 2) * density(k / n) for k in range(1, n))) / (3 * n)


def test_paired_t_and_pvalue(spark):
    a = spark.createDataFrame([("1", 0.5), ("2", 1.0), ("3", 0.2), ("4", 0.0)], "qid string, rr double")
    b = spark.createDataFrame([("1", 0.25), ("2", 0.5), ("3", 0.2), ("4", 0.1)], "qid string, rr double")
    r = M.paired_t(a, b).collect()[0]
    d = [0.25, 0.5, 0.0, -0.1]
    mu = sum(d) / 4
    sd = math.sqrt(sum((x - mu) ** 2 for x in d) / 3)
    assert abs(r.t_stat - round(mu / (sd / 2), 6)) < 1e-6
    # two-sided p of t = 2.0 with 10 dof (tables: 0.0734)
    assert abs(_tail(2.0, 10) - 0.07339) < 1e-4
    same = M.paired_t(a, a).collect()[0]
    assert same.t_stat is None


def test_pvalue_column_matches_the_tail_of_the_density(spark):
    from pyspark.sql import functions as F
    cases = [(t, n) for t in (0.0, 0.3, -1.7, 2.0, 12.5) for n in (2, 3, 4, 5, 11, 12, 200, 201)]
    rows = spark.createDataFrame(cases + [(None, 5), (None, 1)], "t double, n long").select(
        "t", "n", M.t_pvalue_column(F.col("t"), F.col("n")).alias("p")).collect()
    assert len(rows) == len(cases) + 2
    for r in rows:
        want = _tail(r.t, r.n - 1)
        assert r.p is None if want is None else abs(r.p - want) < 1e-9, r
