"""SRC1: scans of stored tables.

A scan names its columns when the caller knows them, so the Parquet reader
prunes the rest; filters applied later are pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulframe.session import prepare

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
         fmt: str = "parquet") -> DataFrame:
    """SRC1: read one table; all columns unless ``columns`` is given."""
    prepare(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.{fmt}" if fmt == "parquet" else f"{sf_dir.rstrip('/')}/{name}"
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


class Tables:
    """Lazy accessor: ``t = Tables(spark, dir); t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return scan(self.spark, self.sf_dir, name)
