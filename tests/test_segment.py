from pyspark.sql import functions as F

from segrank.operators import segment as T


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_packing_budget_and_oversize(spark):
    # 3-token sentences with budget 5: one sentence per passage after the first fits
    docs = _docs(spark, [("d", "a b c. d e. f g h i j k l. m.")])
    p = T.split_passages(docs, 5).orderBy("psg").collect()
    assert [r.text for r in p] == ["a b c. d e.", "f g h i j k l.", "m."]
    assert [r.n_tok for r in p] == [5, 7, 1]
    assert all(r.n_psg == 3 for r in p)


def test_first_sentence_oversize_starts_at_zero(spark):
    docs = _docs(spark, [("d", "a b c d e f g. h.")])
    p = T.split_passages(docs, 3).orderBy("psg").collect()
    assert [(r.psg, r.text) for r in p] == [(0, "a b c d e f g."), (1, "h.")]


def test_empty_and_punctuation_only(spark):
    docs = _docs(spark, [("e", ""), ("p", "... !!! ??"), ("n", None)])
    p = T.split_passages(docs, 10).collect()
    # punctuation-only text yields sentences without tokens -> passages with 0 tokens
    assert all(r.doc_id == "p" for r in p)
    assert sum(r.n_tok for r in p) == 0
    toks = T.tokenize(T.split_passages(docs, 10)).count()
    assert toks == 0


def test_newline_ends_sentence_and_lowercase_tokens(spark):
    docs = _docs(spark, [("d", "Héllo Wörld\nSecond line 12")])
    p = T.split_passages(docs, 2).orderBy("psg").collect()
    assert [r.text for r in p] == ["Héllo Wörld", "Second line 12"]
    toks = [r.term for r in T.tokenize(T.split_passages(docs, 100)).orderBy("pos").collect()]
    assert toks == ["héllo", "wörld", "second", "line", "12"]


def test_first_k_integer_vs_legacy_order(spark):
    rows = [("d", i, f"t{i}") for i in range(12)]
    ps = spark.createDataFrame(rows, "doc_id string, psg int, text string")
    assert sorted(r.psg for r in T.first_k_passages(ps, 3).collect()) == [0, 1, 2]
    assert sorted(r.psg for r in T.first_k_passages(ps, 3, legacy_order=True).collect()) == [0, 1, 10]
    assert T.first_k_text(ps, 2).collect()[0].text == "t0 t1"


def test_reindex_and_max(spark):
    ps = spark.createDataFrame([("d", 0, "a"), ("d", 3, "b"), ("d", 7, "c"), ("e", 5, "x")],
                               "doc_id string, psg int, text string")
    r = {(x.doc_id, x.text): x.psg for x in T.reindex_passages(ps).collect()}
    assert r == {("d", "a"): 0, ("d", "b"): 1, ("d", "c"): 2, ("e", "x"): 0}
    assert T.max_passages(ps).collect()[0].max_passages == 3


def test_normalise_and_blocklist(spark):
    docs = _docs(spark, [("d", "a\tb\nc")])
    assert T.normalise_collection(docs).collect()[0].text == "a b c"
    toks = spark.createDataFrame([("d", 0, 0, "a"), ("d", 0, 1, "b")], "doc_id string, psg int, pos int, term string")
    bl = spark.createDataFrame([("a",)], "term string")
    assert [r.term for r in T.drop_blocked(toks, bl).collect()] == ["b"]
