"""Operator 7: exact dedup against a brute-force version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from haulframe.llm import dedup

ROWS = [
    (1, "a b", "x"), (2, "ab ", "y"), (3, "ab", "z"), (4, None, "n"), (5, "", "e"), (6, " \t\n\x0b\x0c\r", "w"),
    (7, "A b", "c"), (8, "é b", "u"), (9, "éb", "u"), (None, "a b", "null id"), (10, "x" * 50_000, "long"),
    (11, "x" * 50_000, "long"), (12, "rep", "1"), (12, "rep", "2"), (12, "re p", "3"), (13, "a b", "nbsp"),
]
SCHEMA = "doc_id bigint, text string, salt string"


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", row[1] or ""), []).append(row)
    out = []
    for content, members in groups.items():
        members.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for nth, r in enumerate(members):
            out.append((r[0], members[0][0], len(members), nth == 0, hashlib.sha256(content.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


@pytest.mark.parametrize("salts", [1, 5])
def test_against_brute_force(spark, salts):
    df = spark.createDataFrame(ROWS * 2, SCHEMA).repartition(7)
    assert got(dedup.exact_dedup(df, salts=salts)) == brute(ROWS * 2)


def test_a_digest_that_collides_merges_nothing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    weak = dedup.exact_dedup(df, digest=lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1))
    assert got(weak) == brute(ROWS)


def test_empty_table(spark):
    assert got(dedup.exact_dedup(spark.createDataFrame([], SCHEMA))) == []


def test_drop_copies_keeps_whole_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    kept = dedup.drop_copies(df)
    assert kept.columns == df.columns
    rows = [tuple(r) for r in kept.collect()]
    want = [r for r in brute(ROWS) if r[3]]
    assert len(rows) == len(want)
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in want)
    assert all(r in ROWS for r in rows)


def test_registered_query(spark):
    from haulframe.llm.queries import op7_exact_dedup
    from tests.conftest import SMALL

    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op7_exact_dedup(spark, SMALL)) == brute([(a, b, None) for a, b in docs])
