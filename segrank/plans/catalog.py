"""Registry of runnable queries: name -> (Spark builder, DuckDB SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver tables and
returns a lazy DataFrame; the SQL text states the same result for the
DuckDB check (``None`` where the operator is iterative or depends on
Spark's own hash, and is checked against brute force in the tests).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segrank.operators import metrics as M
from segrank.operators import retrieve as R
from segrank.plans import oracle as O
from segrank.plans.derived import Tables

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Callable[[Tables], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        REGISTRY[name] = (build, sql)
        return fn
    return deco


# ------------------------------------------------------------------ flagship

FLAGSHIP_N = 4


def flagship_run(t: Tables) -> DataFrame:
    return R.retrieve_first(t.postings, t.query_impacts, t.lexicon, t.weight, FLAGSHIP_N, 1000)


@register("l1_maxp_dot_eval", O.with_base(
    f"doc_vec AS ({O.doc_agg_sql('max', FLAGSHIP_N)})",
    f"run AS ({O.dot_run_sql('query_impacts', 'doc_vec', 1000)})",
    final=O.summary_sql("run")))
def l1_maxp_dot_eval(t: Tables) -> DataFrame:
    """Flagship: passages -> tf-idf impacts -> max over the first 4 passages
    -> dot-product retrieval (top 1000) -> MRR@10, nDCG@10, recall@1000."""
    return M.summary(flagship_run(t), t.qrels)


def build_all() -> dict[str, Builder]:
    from segrank.plans import (queries_analysis, queries_io, queries_rerank,  # noqa: F401
                               queries_retrieval, queries_text, queries_vectors)
    return {k: v[0] for k, v in REGISTRY.items()}


def all_sql() -> dict[str, str]:
    build_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
