import importlib

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_contract_keys():
    e = importlib.import_module("__spark_entry__")
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100
    own = {k for k in q if k != "pipeline" and not (k.startswith("op") and k[2].isdigit())}
    assert own == set(s) & own


def test_entry_runs(spark):
    e = importlib.import_module("__spark_entry__")
    rows = e.entry(spark).collect()
    assert len(rows) == 1 and rows[0].n_queries > 0


def _norm(tbl):
    cols = sorted(tbl.column_names)
    data = [tbl.column(c).to_pylist() for c in cols]
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in zip(*data))


def test_oracle_matches_on_smallest_fixture(spark):
    e = importlib.import_module("__spark_entry__")
    q, s = e.queries(), e.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ["t2_passages", "e2_impacts", "a5_exp_n3", "r4_bm25_run", "k13_pooled_exact", "c4_distribution", "v1_v3_ratios"]:
        a = q[name](spark, SF).toArrow()
        b = con.sql(s[name]).to_arrow_table()
        assert sorted(a.column_names) == sorted(b.column_names), name
        assert _norm(a) == _norm(b), name
