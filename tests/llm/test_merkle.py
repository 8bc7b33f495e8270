"""Operator 2: the audit against a direct comparison of records."""

import random

from haulframe.llm import merkle

SCHEMA = "file bigint, offset bigint, length bigint, digest string, node string"


def audit(spark, a, b):
    x, y = (spark.createDataFrame([(*r, "n") for r in rows], SCHEMA).repartition(3) for rows in (a, b))
    top = merkle.reach(x, y)
    small = {"range_bytes": 100, "fanout": 3}
    found = merkle.audit(spark, merkle.tree(x, top, **small), merkle.tree(y, top, **small))
    return sorted(((r.file, r.offset, r.kind) for r in found.collect()))


def replica(seed=1, files=7, records=60):
    rng = random.Random(seed)
    rows = []
    for f in range(files):
        at = 0
        for _ in range(rng.randint(1, records)):
            n = rng.randint(1, 90)
            rows.append((f, at, n, f"{rng.random()}"))
            at += n
    return rows


def test_equal_replicas(spark):
    rows = replica()
    assert audit(spark, rows, rows[::-1]) == []
    assert audit(spark, [], []) == []


def test_each_kind_of_damage(spark):
    rows = replica()
    damaged = [(*r[:3], "bad") if i % 40 == 3 else r for i, r in enumerate(rows) if i % 55 != 7] + [(2, 10 ** 6, 5, "more"), (30, 0, 1, "new file")]
    left, right = ({r[:2]: r[3] for r in x} for x in (rows, damaged))
    want = [(*k, "missing" if k not in right else "extra" if k not in left else "changed")
            for k in {**left, **right} if left.get(k) != right.get(k)]
    assert audit(spark, rows, damaged) == sorted(want)


def test_nulls_and_repeated_keys(spark):
    a = [(0, 0, 5, None), (0, 5, 5, "x"), (None, 0, 1, "skip"), (0, None, 1, "skip"), (1, 0, 5, "d"), (1, 0, 5, "d")]
    b = [(0, 0, 5, "null?"), (0, 5, 5, "x"), (1, 0, 5, "d")]
    assert audit(spark, a, b) == [(0, 0, "changed"), (1, 0, "changed")]
    assert audit(spark, a, []) == [(0, 0, "missing"), (0, 5, "missing"), (1, 0, "missing")]


def test_offsets_of_an_archive(spark):
    pages = spark.createDataFrame([(3, "u", "abc"), (1, None, None), (2, "v", "é" * 1000), (2, "v", "é" * 1000), (None, "w", "")],
                                  "page_id bigint, url string, html string")
    rows = sorted(merkle.archive(pages, file_records=3).collect(), key=lambda r: (r.file, r.offset))
    assert [(r.file, r.page_id) for r in rows] == [(0, 1), (0, 2), (0, 2), (1, 3), (1, None)]
    for x, y in zip(rows, rows[1:]):
        assert y.offset == (x.offset + x.length if x.file == y.file else 0)
    assert all(r.digest == r.copy_digest for r in rows)
    assert merkle.archive(pages.limit(0)).collect() == []
