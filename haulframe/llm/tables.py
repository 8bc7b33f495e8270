"""Small shared pieces: table access, written intermediates, salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.session import materialize

__all__ = ["table", "written", "salt_of", "with_salts", "repeated"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor re-reads the files, and every branch
    that follows sees the same rows.
    """
    return materialize(df, f"llm-{name}")


def salt_of(salts: int, *cols: str | Column) -> Column:
    """A salt in [0, salts) from the values of ``cols`` (nulls allowed)."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def with_salts(df: DataFrame, salts: int, out: str) -> DataFrame:
    """Each row once per salt, for the small side of a salted join."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def repeated(df: DataFrame, times: str, out: str | None = None, block: int = 65536) -> DataFrame:
    """Each row ``times`` times (a bigint column, which is dropped); ``out``: the number of the copy, from 1.

    Written out in blocks, so no array is longer than ``block`` however often a row repeats.
    """
    first = F.col("__block") * block
    blocks = df.where(F.col(times) > 0).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / block))))
    copies = blocks.withColumn("__copy", F.explode(F.sequence(first + 1, F.least(F.col(times), first + block)))).drop(times, "__block")
    return copies.withColumnRenamed("__copy", out) if out else copies.drop("__copy")
