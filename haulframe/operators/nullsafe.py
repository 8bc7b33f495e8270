"""Joins in which a null key equals a null key, so that aggregates joined back lose no row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, matched on ``keys`` with nulls equal."""
    names = {k: f"_right_{k}" for k in keys}
    r = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[n]) for k, n in names.items()])
    return left.join(r, same, how).drop(*names.values())
