"""PAG1, PAG2: pages of any depth equal a sorted table's, and no page sorts or writes the table."""

import random

import pytest
from pyspark.sql import functions as F

from haulframe.operators import pages
from haulframe.operators.ordering import page, table_request

ROWS = [(i, random.Random(i).choice([None, 1, 2, 3, 4, 5]), f"n{i % 7}", "x" * 50) for i in range(500)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, k int, name string, wide string").repartition(5)


def expected(order):
    rows = list(ROWS)
    for c, desc in reversed(pages.pairs(order)):
        at = {"id": 0, "k": 1, "name": 2}[c]
        # nulls are smallest: first when ascending, last when descending
        rows.sort(key=lambda r: (r[at] is not None, r[at] if r[at] is not None else 0), reverse=desc)
    return [r[0] for r in rows]


@pytest.mark.parametrize("order", [["k", "id"], [("k", "desc"), "id"], [("name", "desc"), ("k", "asc"), ("id", "desc")]])
def test_every_way_gives_the_same_page(table, order):
    want = expected(order)
    index = pages.RankIndex(table, order)
    assert index.total == 500
    for start, length in ((0, 7), (63, 40), (240, 25), (480, 50), (499, 1)):
        got = index.rows(start, length).collect()
        assert [r.id for r in got] == want[start:start + length], (order, start)
        assert [r["__pos"] for r in got] == list(range(start + 1, min(start + length, 500) + 1))
    for start in (0, 100, 250, 460, 495, 600):
        for heap in (20, 10_000):
            got = pages.page_rows(table, order, start, 20, 500, heap)
            assert [r.id for r in got.collect()] == want[start:start + 20] and got.columns == table.columns


def test_repeated_rows_have_a_place_each(spark):
    df = spark.createDataFrame([(i // 10, "a") for i in range(100)] + [(None, "b")] * 15, "k int, v string").repartition(4)
    index = pages.RankIndex(df, ["k", "v"])
    found = []
    for start in range(0, 115, 8):
        found += [r.k for r in index.rows(start, 8).collect()]
    assert found == [None] * 15 + [i // 10 for i in range(100)]


def test_nothing_but_the_keys_is_sorted(table):
    """A shallow page is a bounded heap; a deep one sorts keys and filters the table by their interval."""
    shallow = pages.page_rows(table, ["k", "id"], 40, 20, 500)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in shallow and "rangepartitioning" not in shallow
    index = pages.RankIndex(table, ["k", "id"])
    assert set(index.index.columns) == {"k", "id", "__part", "__nth"}


def test_deep_pages_filter_the_scan(spark, tmp_path):
    spark.range(2000).select(F.col("id"), (F.col("id") * 3).alias("v")).write.parquet(f"{tmp_path}/t")
    rows = pages.RankIndex(spark.read.parquet(f"{tmp_path}/t"), ["id"]).rows(1000, 10)
    assert [r.v for r in rows.collect()] == [3 * i for i in range(1000, 1010)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,1000), LessThanOrEqual(id,1009)" in plan


def test_requests_and_clamped_pages(table, spark):
    got = page(table, ["id"], 99, 30).collect()
    assert [r.id for r in got] == list(range(480, 500)) and got[0].total == 500 and (got[0].from_row, got[0].to_row) == (481, 500)
    r = table_request(table, {"draw": 2, "start": 5, "length": -1, "order": [("id", "desc")]}, [])
    assert [x.id for x in r.collect()] == list(range(494, -1, -1))
    empty = page(table.limit(0), ["id"], 3, 10)
    assert empty.collect() == [] and "total" in empty.columns
