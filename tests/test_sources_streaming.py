import os

from segrank.sources import io


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_tsv_and_passage_readers(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c.tsv")
    _write(p, "d1\thello world\nbad line\nd2\ta\tb\nd3\tok\n")
    rows, rej = io.read_two_field_tsv(spark, p)
    assert sorted((r.id, r.text) for r in rows.collect()) == [("d1", "hello world"), ("d3", "ok")]
    assert rej.count() == 2
    pp = os.path.join(tmpdir_path, "p.tsv")
    _write(pp, "d@@0\tfirst\nd@@1\tsecond\nd@@0\tfirst again\nx@@y\tbad\n")
    ps, rej = io.read_passages_tsv(spark, pp)
    got = sorted((r.doc_id, r.psg, r.text) for r in ps.collect())
    assert got == [("d", 0, "first again"), ("d", 1, "second")]
    assert rej.count() == 1


def test_readers_reject_bad_lines(spark, tmpdir_path):
    def probe(read, text, *args):
        p = os.path.join(tmpdir_path, "probe.txt")
        _write(p, text)
        rows, rej = read(spark, p, *args)
        out = sorted(tuple(r) for r in rows.collect())
        assert rows.count() == len(out)
        return out, sorted(r.value for r in rej.collect())

    assert probe(io.read_two_field_tsv, "d1\ta\nd2\t\n") == ([("d1", "a")], ["d2\t"])
    assert probe(io.read_passages_tsv, "d@@0\ta\nnosep\tb\nno tab\n") == ([("d", 0, "a")], ["no tab", "nosep\tb"])
    assert probe(io.read_passages_tsv, "d.0\ta\nd0\tb\n", ".") == ([("d", 0, "a")], ["d0\tb"])
    assert probe(io.read_passages_tsv, "a-b-3\ta\n", "-") == ([("a-b", 3, "a")], [])
    assert probe(io.read_trec_run, "q Q0 d 1 2.5 t\nq Q0 d\nq Q0 d x 2.5 t\n") == ([("q", "d", 1, 2.5, "t")], ["q Q0 d", "q Q0 d x 2.5 t"])
    assert probe(io.read_trec_run, "q Q0 d@@1 1 2.5 t\nq Q0 d 1 2.5 t\n", "@@") == ([("q", "d", 1, 1, 2.5, "t")], ["q Q0 d 1 2.5 t"])
    assert probe(io.read_qrels, "q 0 d 1\nq 0 d\nq 0 d x\n") == ([("q", "d", 1)], ["q 0 d", "q 0 d x"])
    assert probe(io.read_triplets, 'q\t"a\tb\nq\ta\n') == ([("q", '"a', "b")], ["q\ta"])
    assert probe(io.read_text_triplets, "q\ta\tb\nq\ta\tb\tc\n") == ([("q", "a", "b")], ["q\ta\tb\tc"])
    assert probe(io.read_json_run, '{"q": {"d": 1.0}}\n{bad\n') == ([("q", "d", 1.0)], ["{bad"])


def test_run_roundtrips(spark, tmpdir_path):
    run = spark.createDataFrame([("q1", "a", 1, 2.5), ("q1", "b", 2, 1.0), ("q2", "c", 1, 3.0)],
                                "qid string, doc_id string, rank int, score double")
    out = os.path.join(tmpdir_path, "run")
    io.write_trec_run(run, out)
    back, rej = io.read_trec_run(spark, out)
    assert rej.count() == 0
    assert sorted((r.qid, r.doc_id, r.rank, r.score) for r in back.collect()) == \
        sorted((r.qid, r.doc_id, r.rank, r.score) for r in run.collect())
    jout = os.path.join(tmpdir_path, "jrun")
    io.write_json_run(run, jout)
    jb, _ = io.read_json_run(spark, jout)
    assert sorted((r.qid, r.doc_id, r.score) for r in jb.collect()) == [("q1", "a", 2.5), ("q1", "b", 1.0), ("q2", "c", 3.0)]
    single = os.path.join(tmpdir_path, "single.json")
    _write(single, '{"q1": {"a": 1.5}, "q2": {"b": 0.5, "c": 0.25}}')
    assert io.read_json_run(spark, single)[0].count() == 3


def test_vectors_and_query_lines(spark, tmpdir_path):
    vec = spark.createDataFrame([("d", "a", 3), ("d", "b", 1), ("e", "a", 2)], "doc_id string, term string, w int")
    out = os.path.join(tmpdir_path, "vec")
    io.write_vectors_jsonl(vec, out)
    with open(os.path.join(out, "bad.txt"), "w") as f:
        f.write("{not json\n")
    rows, rej = io.read_vectors_jsonl(spark, out)
    assert {r.id: dict(r.vector) for r in rows.collect()} == {"d": {"a": 3, "b": 1}, "e": {"a": 2}}
    assert rej.count() == 1
    q = spark.createDataFrame([("q", "b", 2), ("q", "a", 1), ("z", "x", 0)], "qid string, term string, qw int")
    lines = {r.qid: r.terms for r in io.query_vector_lines(q).collect()}
    assert lines == {"q": "a b b"}


def test_qrels_and_triplets(spark, tmpdir_path):
    qp = os.path.join(tmpdir_path, "qrels.txt")
    _write(qp, "1 0 d1 1\n1 0 d2 0\n")
    assert io.read_qrels(spark, qp)[0].count() == 2
    tp = os.path.join(tmpdir_path, "t.tsv")
    _write(tp, "q\tp\tn\n")
    assert io.read_triplets(spark, tp)[0].collect()[0].neg_id == "n"


def test_streaming_ingest(spark, tmpdir_path):
    from segrank.streaming.ingest import start_ingest
    src = os.path.join(tmpdir_path, "in")
    spark.createDataFrame([(1, "Alpha beta. Gamma delta.", "en", "s", 24)],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(src)
    tw = spark.createDataFrame([("alpha", 1.0), ("gamma", 2.0)], "term string, scale double")
    out = os.path.join(tmpdir_path, "out")
    q = start_ingest(spark, src, out, tw, budget=2, name="t" + os.path.basename(tmpdir_path))
    q.awaitTermination(120)
    ps = spark.read.parquet(os.path.join(out, "passages"))
    assert sorted(r.text for r in ps.collect()) == ["Alpha beta.", "Gamma delta."]
    imp = {r.term: r.w for r in spark.read.parquet(os.path.join(out, "impacts")).collect()}
    assert imp == {"alpha": 100, "gamma": 200}
    assert {(r.stream, r.batch) for r in spark.read.parquet(os.path.join(out, "passages")).collect()} == {
        ("t" + os.path.basename(tmpdir_path), 0)}


def _docs(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(path)


def test_store_reuses_finished_tables_only(spark, tmpdir_path):
    from segrank.sources.store import Store
    src, root = os.path.join(tmpdir_path, "in.parquet"), os.path.join(tmpdir_path, "root")
    _docs(spark, src, [(1, "a"), (2, "b")])
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(src)

    def rows(**params):
        return sorted(r.doc_id for r in Store(spark, {"documents": src}, root).table("t", ["documents"], build, **params).collect())

    assert rows() == rows() == [1, 2] and len(made) == 1
    assert rows(k=2) == [1, 2] and len(made) == 2             # other parameters
    _docs(spark, src, [(1, "a"), (3, "c"), (4, "d")])
    assert rows() == [1, 3, 4] and len(made) == 3             # changed input
    store = Store(spark, {"documents": src}, root)
    place = store.place("u", ["documents"], {})
    spark.range(5).write.parquet(f"{place}/data-unfinished")  # a write that never ended has no marker
    assert store.table("u", ["documents"], build).count() == 3 and len(made) == 4
    import shutil
    shutil.rmtree(root)                                       # the shared folder was cleared within the session
    assert rows() == [1, 3, 4] and len(made) == 5


def test_bucketed_table_is_found_again_without_the_catalog(spark, tmpdir_path):
    from segrank.sources.store import Store
    src, root = os.path.join(tmpdir_path, "in.parquet"), os.path.join(tmpdir_path, "root")
    _docs(spark, src, [(k, f"t{k % 7}") for k in range(50)])
    build = lambda: spark.read.parquet(src).repartition(4, "text")
    store = Store(spark, {"documents": src}, root)
    first = store.bucketed("b", ["documents"], build, ["text"], ["text"], 4)
    assert first.count() == 50
    spark.sql(f"DROP TABLE {store._name(store._finished(store.place('b', ['documents'], {'by': ['text'], 'sort': ['text'], 'buckets': 4})))}")
    again = store.bucketed("b", ["documents"], build, ["text"], ["text"], 4)
    assert sorted(again.collect()) == sorted(spark.read.parquet(src).collect())
    assert "Exchange" not in again.groupBy("text").count()._jdf.queryExecution().executedPlan().toString()


def test_sliced_postings(spark, tmpdir_path):
    """Terms above SLICE_ROWS are cut into slices; runs do not change."""
    from segrank.operators import retrieve as R
    from segrank.plans.derived import Tables
    whole, cut = Tables(spark, "/root/testdata/sf0.001"), Tables(spark, "/root/testdata/sf0.001", slice_rows=20)
    assert cut.postings.agg({"slice": "max"}).first()[0] >= 5 and whole.postings.agg({"slice": "max"}).first()[0] == 0
    cols = ["term", "doc_id", "tf", "df", "hits"]
    assert sorted(map(repr, whole.postings.select(cols).collect())) == sorted(map(repr, cut.postings.select(cols).collect()))
    for run in (R.bm25, R.rm3, R.sdm_bm25):
        assert sorted(run(whole, whole.query_tokens, 50).collect()) == sorted(run(cut, cut.query_tokens, 50).collect())


def test_line_offsets_across_blocks_and_files(spark, tmpdir_path):
    from segrank.operators import segment
    lines = [f"{k:03d}" + "é" * (k * 7 % 40) + ("\r" if k % 5 == 0 else "") for k in range(200)]
    p = os.path.join(tmpdir_path, "lines")
    os.makedirs(p)
    for k in range(2):
        with open(os.path.join(p, f"part-{k}.txt"), "w", newline="") as f:
            f.write("".join(x + "\n" for x in lines[100 * k:100 * k + 100]))
    at, offsets = 0, []
    for x in lines:
        offsets.append((x, at))
        at += len(x.encode()) + 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")       # blocks that end within lines
        got = segment.line_splits(io.read_lines_with_offsets(spark, p), 3).collect()
        assert len({r.offset for r in got}) == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.value, r.offset) for r in got) == sorted(offsets)
    assert all(r.split == r.offset * 3 // at for r in got) and {r.split for r in got} == {0, 1, 2}


def test_training_log(spark):
    from segrank.operators import metrics as M
    h = spark.createDataFrame([(0, "O_1", 0.1), (50, "O_1", 0.3), (120, "O_1", 1.0)], "step int, name string, value double")
    got = {r.bucket: r.value for r in M.training_log(h, 100).collect()}
    assert got == {0: 0.2, 1: 1.0}
