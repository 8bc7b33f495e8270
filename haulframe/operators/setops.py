"""SET1-SET4, JOIN3: unions, tag lists and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append(df: DataFrame, more: DataFrame, prepend: bool = False, order_col: str = "_src") -> DataFrame:
    """SET1: append (or prepend) rows, duplicates kept, missing columns null.

    Order only exists with a sort key, so the result carries ``order_col``
    (0 for the first part, 1 for the second) to sort on when it matters.
    """
    a, b = (more, df) if prepend else (df, more)
    return a.withColumn(order_col, F.lit(0)).unionByName(b.withColumn(order_col, F.lit(1)),
                                                         allowMissingColumns=True)


def tagged_union(sources: dict[str, DataFrame], display: str, tag: str = "group") -> DataFrame:
    """SET2: union of named sources, each row tagged with its source; null and boolean items skipped.

    A source of bare strings (one text column of whatever name) is wrapped
    into rows with the ``display`` column.
    """
    parts = []
    for name, df in sources.items():
        if df.columns != [display] and [kind for _, kind in df.dtypes] == ["string"]:
            df = df.toDF(display)
        if dict(df.dtypes)[display] != "boolean":
            parts.append(df.where(F.col(display).isNotNull()).withColumn(tag, F.lit(name)))
    if not parts:  # only boolean items
        return reduce(DataFrame.unionAll, [df.select(F.lit(None).cast("string").alias(display), F.lit("").alias(tag)).limit(0) for df in sources.values()])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_tags(df: DataFrame, owner: str, tag: str, arrival: str, case_sensitive: bool = False,
                  limit: int | None = None) -> DataFrame:
    """SET3: distinct tags per owner in first-arrival order, trimmed, empty ones left out,
    optionally case-insensitive, capped.

    The first arrival of each (owner, tag) is a partial aggregate (skew-safe);
    the per-owner ranking runs on that aggregated table.
    """
    key = F.col(tag) if case_sensitive else F.lower(F.col(tag))
    df = df.withColumn(tag, F.trim(tag)).where(F.col(tag) != "")
    firsts = df.groupBy(owner, key.alias("_k")).agg(
        F.min_by(F.col(tag), F.col(arrival)).alias(tag), F.min(arrival).alias("first_arrival"))
    w = Window.partitionBy(owner).orderBy("first_arrival", "_k")  # tags that arrived together go by name
    r = firsts.withColumn("tag_rank", F.row_number().over(w))
    if limit is not None:
        r = r.where(F.col("tag_rank") <= limit)
    return r.drop("_k")


def subtract_keep(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """SET4: rows of a whose key is not in b, a's duplicates kept (left anti join, not EXCEPT)."""
    return a.join(b.select(*on), on, "left_anti")


def exclude(df: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """JOIN3: drop rows already chosen."""
    return df.join(chosen, on, "left_anti")
