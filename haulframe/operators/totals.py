"""Whole-table aggregates attached to every row, computed once.

A scalar subquery written into several expressions is planned once per
occurrence.  ``with_totals`` evaluates all requested aggregates in ONE
scalar subquery returning a struct, attaches it as a column and exposes
its fields; Catalyst keeps the projection (the subquery is not cheap to
duplicate), so the table is aggregated once, with partial aggregation,
and nothing is collected to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, totals: dict[str, Column], source: DataFrame | None = None) -> DataFrame:
    """Add one column per aggregate over ``source`` (default ``df``)."""
    src = source if source is not None else df
    s = src.select(F.struct(*[e.alias(k) for k, e in totals.items()])).scalar()
    d = df.withColumn("_totals", s)
    return d.select(*[F.col(c) for c in df.columns], *[F.col("_totals")[k].alias(k) for k in totals])
