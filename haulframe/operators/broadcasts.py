"""Broadcast hints behind a size check.

A broadcast copies a table to every executor, so it is only safe for a
table whose size is bounded.  ``checked_broadcast`` counts the rows first
(one small job) and hints the broadcast only under the bound; above it the
table is joined normally and AQE picks the strategy from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
