"""Every registered job against its DuckDB statement on sf0.001 (jobs without SQL: they run)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

from haulframe.plans.registry import load_all
from haulframe.sources.tables import TABLES
from tests.conftest import SMALL

JOBS = load_all()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job(spark, con, name):
    j = JOBS[name]
    df = j.fn(spark, SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if j.sql is None:
        return
    cur = con.execute(j.sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert _rows(cols, rows) == _rows(dcols, cur.fetchall())
