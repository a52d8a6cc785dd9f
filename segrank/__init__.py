"""segrank: ranked retrieval and analysis over long documents on Spark.

Documents are split into passages, turned into sparse term-weight
tables, aggregated to document level, retrieved, reranked with
sequential-dependence features and evaluated - all as lazy DataFrame
plans. See README.md for the module map.
"""

from segrank.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
