"""Plan-shape checks: what is scanned and exchanged, top-k, and how often stored tables are read."""

import re

from segrank.operators import retrieve as R
from segrank.operators.postings import with_lexicon
from segrank.plans import catalog
from segrank.plans.derived import Tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(df) -> int:
    """Scans of anything that grows with the documents, as planned (AQE reuses equal exchanges on top of that)."""
    return sum("FileScan" in x and not re.search(r"benchmark\.parquet", x) for x in _plan(df).splitlines())


def test_impacts_are_read_from_the_postings_without_exchange(spark):
    p = _plan(Tables(spark, SF).impacts)
    assert "Exchange" not in p and "Join" not in p
    assert "n_chars" not in p and "lang" not in p


def test_no_exchange_between_postings_and_query_terms(spark):
    """The join on (term, slice) takes the stored buckets as they are, whether or not the query side is broadcast."""
    t = Tables(spark, SF)
    q = with_lexicon(t.query_impacts.select("qid", "term", "qw"), t.lexicon).drop("df", "dfs")
    p = _plan(t.postings.join(q.hint("merge"), ["term", "slice"]))
    branch = p[:p.index("FileScan parquet spark_catalog")] if "FileScan parquet spark_catalog" in p else p
    lines = p.splitlines()
    at = next(k for k, x in enumerate(lines) if "Bucketed: true" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*("))
    above, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            above.append(x)
            level = depth(x)
    upto = next(k for k, x in enumerate(above) if "SortMergeJoin" in x)
    assert branch and not any("Exchange" in x for x in above[:upto])


def test_retrieval_has_no_nested_loop_and_a_partial_top_k(spark):
    t = Tables(spark, SF)
    run = R.retrieve_first(t.postings, t.query_impacts, t.lexicon, t.weight, 2, 100)
    phys = _plan(run)
    assert "BroadcastNestedLoopJoin" not in phys and "CartesianProduct" not in phys
    assert "WindowGroupLimit" in phys          # partial top-k before the shuffle on qid


def test_queries_read_stored_tables_few_times(spark):
    q = catalog.build_all()
    for name, most in (("r4_bm25_run", 2), ("r5_rm3_run", 5), ("r6_sdm_run", 4), ("k12_passage_features_soft", 4), ("k16_rerank_exact_eval", 8),
                       ("c10_run_split", 6), ("l1_maxp_dot_eval", 6)):
        df = q[name](spark, SF)
        assert _scans(df) <= most, (name, _scans(df))


def test_static_broadcast_disabled(spark):
    Tables(spark, SF)  # applies the runtime settings
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
