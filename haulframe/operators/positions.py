"""Global row numbers without a single-partition window.

``row_number() over (order by ...)`` with no partition key moves the whole
table into one task.  Here the table is range-partitioned on the order
(Spark samples the bounds), sorted inside each partition, and numbered by
its in-partition position plus the row count of all earlier partitions.
The per-partition counts form a table with one row per partition, which is
the only thing broadcast.

The order must be total (end it with a unique key).  The sorted table,
with each row's partition id and in-partition index, is written once as
Parquet to the shared checkpoint folder; the per-partition counts and the
numbering both read that copy.  Computing them from two executions of the
range exchange is not safe: the two plans are pruned differently, and at
scale their sampled range bounds can differ, which silently misnumbers
rows.  The written copy also means a lost executor re-reads files instead
of recomputing the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.session import ensure_checkpoint_dir, materialize


def sorted_partitions(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def global_row_number(df: DataFrame, order: list[Column], out: str = "position",
                      partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order`` (which must be total)."""
    s = sorted_partitions(df, order, partitions)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    ensure_checkpoint_dir(df.sparkSession)
    s = materialize(s, "positions")
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + local + 1)
            .drop("_pid", "_mid", "_off"))


def global_running_sum(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` up to and including each row in ``order`` (which must be total).

    Running sums inside each range partition, plus the sums of all earlier
    partitions (one row per partition).
    """
    s = sorted_partitions(df, order).withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    s = materialize(s, "running-sum")
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = s.groupBy("_pid").agg(F.sum(value).alias("_n"))
    offsets = parts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    inside = F.sum(value).over(Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0))
    # one row per partition: bounded by the partition count, safe to broadcast
    return s.withColumn("_in", inside).join(F.broadcast(offsets), "_pid").withColumn(out, F.col("_off") + F.col("_in")).drop(
        "_pid", "_mid", "_off", "_in")
