"""Operator 3: exact top-k against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulframe.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, uid bigint"


def brute(rows, k=5):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    docs = [(i, [math.floor(256 * x) if abs(256 * x) < 2 ** 52 else int(256 * x) for x in v]) for i, v, _ in rows if i is not None and ok(v)]
    out = []
    for a, (q, v) in enumerate(docs):
        if q % 50 == 0:
            scored = sorted((-max(min(sum(x * y for x, y in zip(v, w)), 2 ** 63 - 1), -2 ** 63), i) for b, (i, w) in enumerate(docs) if a != b)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return got(topk.top_k(df, F.col("vec_id") % 50 == 0, **options))


@pytest.mark.parametrize("options", [{}, {"block_rows": 7, "shard_blocks": 3, "group_queries": 2}])
def test_against_all_pairs(spark, options):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], 0) for i in range(400)]
    rows += [(i, rows[50][1], 0) for i in range(400, 460)]  # ties
    rows += [(460, None, 0), (461, [1.0, None], 0), (462, [float("nan")] * 8, 0), (500, [float("inf")] * 8, 0), (None, rows[0][1], 0),
             (550, [], 0), (463, [1.0, -2.0], 0), (600, [0.0] * 8, 0), (50, rows[50][1], 0), (51, rows[51][1], 0)]
    assert run(spark, rows, **options) == brute(rows)


def test_few_rows(spark):
    assert run(spark, [(0, [1.0], 0), (3, [2.0], 0)]) == [(0, 1, 3, 256 * 512)]
    assert run(spark, [(0, [1.0], 0)]) == []
    assert run(spark, []) == []


def test_large_components(spark):
    rows = [(0, [1e12, -3e5], 0), (1, [2e12, 1.0], 0), (2, [-5e15, 0.5], 0), (3, [1e300, 0.0], 0), (50, [-1e300, 1.0], 0)]
    assert run(spark, rows) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    docs, queries = rng.integers(-300, 300, (40, 6)).astype(float), rng.integers(-300, 300, (9, 6)).astype(float)
    upper = topk.bounds(queries, docs.max(axis=0)[None], docs.min(axis=0)[None])[:, 0]
    assert (topk.products(queries, docs).max(axis=1) <= upper).all()
