"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000     # rows of the query side, about 100 MB; beyond it the join is an ordinary one


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` rows, which are counted first; otherwise as it is, and the
    planner exchanges it.  Meant for query sides, whose derivation is cheap beside the table that they meet."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
