"""PAG1, PAG2: a page of an ordered table without sorting the table.

A page near the start or the end needs a bounded heap per task and nothing
else (``TakeOrderedAndProject``).  For a page in between, only the order
keys are sorted: they are range-partitioned, written once and counted per
partition.  The counts say which partitions hold the page; their rows at the
page's positions give the keys of the page, the interval of the first key
goes to the scan of the table as a filter, and the page's rows are found by
their keys.  A ``RankIndex`` serves any number of pages.

An order is a list of columns, ``"name"`` or ``("name", "asc" | "desc")``,
nulls first when ascending and last when descending.  Rows that are equal
in all order columns keep no particular order among themselves; each still
has one position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.operators.positions import sorted_partitions
from haulframe.session import ensure_checkpoint_dir, materialize

Order = Sequence[str | tuple[str, str]]
#: Rows that a heap may hold in each task; pages that end further in use the index.
HEAP_ROWS = 10_000


def pairs(order: Order) -> list[tuple[str, bool]]:
    """(column, descending) of each key."""
    return [(o, False) if isinstance(o, str) else (o[0], o[1] == "desc") for o in order]


def sort_columns(order: Order, reverse: bool = False) -> list[Column]:
    return [F.col(c).desc() if desc != reverse else F.col(c).asc() for c, desc in pairs(order)]


class RankIndex:
    """The order keys of a table, range-partitioned and counted."""

    def __init__(self, df: DataFrame, order: Order):
        self.df, self.order, self.keys = df, order, [c for c, _ in pairs(order)]
        ensure_checkpoint_dir(df.sparkSession)
        keys = sorted_partitions(df.select(*self.keys), sort_columns(order))
        local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        self.index = materialize(keys.withColumns({"__part": F.spark_partition_id(), "__nth": local}), "rank-index")
        # one row per partition
        counts = {r["__part"]: r["n"] for r in self.index.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.before, self.total = {}, 0
        for part in sorted(counts):
            self.before[part] = self.total
            self.total += counts[part]

    def rows(self, start: int, length: int) -> DataFrame:
        """The rows at positions start + 1 to start + length, in order, with their ``__pos``."""
        end = min(start + length, self.total)
        parts = [p for p in self.before if self.before[p] < end and start < self._end(p)]
        before = F.element_at(F.create_map(*[F.lit(x) for p in parts or [0] for x in (p, self.before.get(p, 0))]), F.col("__part"))
        found = self.index.where(F.col("__part").isin(parts or [-1])).withColumn("__pos", before + F.col("__nth") + 1)
        wanted = found.where((F.col("__pos") > start) & (F.col("__pos") <= end))
        # the position of a key's first row in the whole order: rows equal in all keys may begin before the page
        places = wanted.groupBy(*self.keys).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__many"))
        names = {c: f"__key{i}" for i, c in enumerate(self.keys)}
        places = places.select(*[F.col(c).alias(n) for c, n in names.items()], "__first", "__many")
        lead = self.keys[0]
        low, high, nulls = wanted.agg(F.min(lead), F.max(lead), F.count_if(F.col(lead).isNull())).first()
        inside = F.col(lead).isNull() if low is None else F.col(lead).between(F.lit(low), F.lit(high))
        table = self.df.where(inside | F.col(lead).isNull() if nulls and low is not None else inside)
        same = [table[c].eqNullSafe(places[n]) for c, n in names.items()]
        near = table.join(places, same)
        nth = F.row_number().over(Window.partitionBy(*names.values()).orderBy("__first"))
        return (near.withColumn("__nth", nth).where(F.col("__nth") <= F.col("__many"))
                .withColumn("__pos", F.col("__first") + F.col("__nth") - 1)
                .drop("__nth", "__first", "__many", *names.values()).orderBy("__pos"))

    def _end(self, part: int) -> int:
        later = [b for p, b in self.before.items() if p > part]
        return min(later) if later else self.total


def page_rows(df: DataFrame, order: Order, start: int, length: int, total: int, heap_rows: int = HEAP_ROWS) -> DataFrame:
    """Rows start + 1 to start + length of ``df`` (of ``total`` rows) in ``order``."""
    if start >= total or length <= 0:
        return df.limit(0)
    if start + length <= heap_rows:
        return df.orderBy(*sort_columns(order)).limit(start + length).offset(start)
    if total - start <= heap_rows:  # from the end
        length = min(length, total - start)
        last = df.orderBy(*sort_columns(order, reverse=True)).limit(total - start)
        return last.orderBy(*sort_columns(order)).limit(length)
    return RankIndex(df, order).rows(start, length).drop("__pos")
