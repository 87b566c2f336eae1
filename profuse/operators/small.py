"""Joins with tables that have one row per feature.

Such a table is collected up to a limit.  Within it the cells are joined by a
broadcast of that local copy, so they are not shuffled by feature (few keys, and
one of them may hold a large share of all cells).  Beyond it the table is stored
and joined as Spark sees fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from profuse.session import stored

SMALL_ROWS = 65_536


def settle(table: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Evaluate a small table once; hinted for broadcast only within ``limit``."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        return stored(table, "table")
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def join_small(cells: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return cells.join(settle(table), list(keys), how)
