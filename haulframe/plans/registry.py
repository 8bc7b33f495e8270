"""Registry of the named table jobs exposed through ``__spark_entry__``.

Each job takes (spark, sf_dir) and returns a lazy DataFrame over the given
tables.  ``sql`` is the equivalent DuckDB statement over the same tables; it
is None for jobs that SQL cannot state (streams, file round trips), which
are checked by pytest instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from haulframe.sources.tables import Tables


@dataclass(frozen=True)
class Job:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


JOBS: dict[str, Job] = {}


def job(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def deco(fn):
        if name in JOBS:
            raise ValueError(f"duplicate job {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        JOBS[name] = Job(name, run, sql.strip() if sql else None)
        return fn

    return deco


def load_all() -> dict[str, Job]:
    # Importing the modules fills JOBS.
    from haulframe.plans import (  # noqa: F401
        jobs_aggs,
        jobs_columns,
        jobs_filters,
        jobs_hooks,
        jobs_io,
        jobs_joins,
        jobs_kpi,
        jobs_order,
        jobs_setops,
        jobs_streams,
        jobs_upserts,
    )
    return JOBS
