"""Operator 10: budgets against hand-worked trees, prefixes against a sort of each leaf."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from haulframe.llm import mixing


def mix(df, **options):
    return mixing.mix(df, {c: F.col(c) for c in ("domain", "lang", "source")}, **options)


SCHEMA = "doc_id bigint, text string, domain string, lang string, source string, n bigint"


def test_shortages_go_to_siblings_first():
    room = {("a", "x", "1"): 10.0, ("a", "x", "2"): 100.0, ("a", "y", "3"): 100.0, ("b", "x", "4"): 1000.0}
    # a and b get 60 each; a/x and a/y 30 each; source 1 can give 10, its sibling takes the rest
    assert mixing.budgets(room, 120, {}) == {("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "3"): 30, ("b", "x", "4"): 60}


def test_what_a_family_lacks_goes_up():
    room = {("a", "x", "1"): 10.0, ("a", "y", "2"): 20.0, ("b", "x", "3"): 1000.0}
    assert mixing.budgets(room, 200, {}) == {("a", "x", "1"): 10, ("a", "y", "2"): 20, ("b", "x", "3"): 170}
    assert sum(mixing.budgets(room, 5000, {}).values()) == 1030


def test_weights():
    room = {("a", "x", "1"): 500.0, ("a", "x", "2"): 500.0, ("b", "x", "3"): 500.0}
    given = mixing.budgets(room, 400, {("a",): 3.0, ("a", "x", "2"): 0.0})
    assert given == {("a", "x", "1"): 300, ("a", "x", "2"): 0, ("b", "x", "3"): 100}


def rows():
    out = [(i, "w " * (i % 13), "d%d" % (i % 2), "en" if i % 3 else None, "s%d" % (i % 5 if i % 4 else 0), 1) for i in range(700)]
    return out + [(900, None, "d0", "en", "s0", 1), (901, "", "d0", "en", "s0", 1), (None, "a b c", "d0", "en", "s0", 1), (5, *out[5][1:]), (5, *out[5][1:])]


def prefixes(df, quota, max_epochs, seed):
    """(leaf, epoch) -> doc_ids, by a sort of each leaf by the seeded order; the order value of each row is Spark's."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    found = df.withColumn("tokens", mixing.word_tokens(F.col("text"))).where("tokens > 0").withColumn("key", key).withColumn(
        "orders", F.array(*[F.xxhash64("key", F.lit(e) + F.lit(seed)) for e in range(max_epochs)])).collect()
    leaves = defaultdict(list)
    for r in found:
        leaves[r.domain or "", r.lang or "", r.source or ""].append(r)
    out = {}
    for leaf, rows in leaves.items():
        tokens = sum(r.tokens for r in rows)
        slices = max(1, -(-len(rows) // mixing.SLICE_ROWS))
        for epoch in range(max_epochs):
            left = quota[leaf] - epoch * tokens
            if left <= 1e-6:
                continue
            if left >= tokens - 1e-6:
                out[leaf, epoch] = sorted(str(r.doc_id) for r in rows)
                continue
            taken, ids = 0, []
            for r in sorted(rows, key=lambda r: (((r.orders[epoch] % 2 ** 64) >> 16) % slices, r.orders[epoch])):
                if taken >= left:
                    break
                taken += r.tokens
                ids.append(str(r.doc_id))
            out[leaf, epoch] = sorted(ids)
    return out


@pytest.mark.parametrize("slice_rows", [4096, 8])
@pytest.mark.parametrize("share, seed", [(0.3, 17), (1.4, 17), (0.55, 3)])
def test_quotas_are_filled_by_prefixes(spark, monkeypatch, slice_rows, share, seed):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    have = defaultdict(int)
    for r in rows():
        have[r[2], r[3] or "", r[4]] += len((r[1] or "").split())
    weights = {("d0",): 3.0, ("d0", "en"): 0.5, ("d1", "en", "s1"): 4.0, ("d0", "en", "s2"): 0.0}
    quota = mixing.budgets({k: 2.0 * v for k, v in have.items() if v}, share * sum(have.values()), weights)
    got = defaultdict(list)
    for r in mix(df, share=share, weights=weights, seed=seed).collect():
        got[r.domain or "", r.lang or "", r.source or "", r["__hf_epoch"]].append(str(r.doc_id))
    want = prefixes(df, quota, 2, seed)
    assert {(*leaf, epoch): ids for (leaf, epoch), ids in want.items()} == {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("seed", range(7))
def test_repeats_do_not_overrun_the_budget(spark, seed):
    """A budget is passed by less than one document, also where its border falls among repeated rows."""
    some = [(i, "w " * (1 + i % 9), "d", "en", "s", 1) for i in range(60)] + [(7, "x y z v", "d", "en", "s", k % 2) for k in range(500)]
    df = spark.createDataFrame(some, SCHEMA).repartition(3)
    out = mix(df, total=1200, max_epochs=1, seed=seed).collect()
    assert 1200 <= sum(r["__hf_tokens"] for r in out) < 1200 + 9
    assert [c for c in out[0].asDict() if not c.startswith("__hf_")] == df.columns


def test_families_are_filled_as_in_the_tree_walk(spark):
    import random

    rng = random.Random(5)
    for case in range(4):
        leaves = [(f"d{rng.randint(0, 2)}", f"l{rng.randint(0, 2)}", f"s{i}", rng.choice([1, 5, 40, 300]), rng.randint(1, 9)) for i in range(40)]
        weights = {(d, lang, s): rng.choice([0.0, 0.5, 2.0, 7.0]) for d, lang, s, _, _ in leaves[::3]} | {("d0",): 3.0, ("d1", "l1"): 0.1}
        want = mixing.budgets({(d, lang, s): 2.0 * t for d, lang, s, t, _ in leaves}, 0.6 * sum(x[3] for x in leaves), weights)
        df = spark.createDataFrame(leaves, "d string, l string, s string, t bigint, n bigint").repartition(3)
        got = defaultdict(float)
        for r in mixing._quotas(df, ["d", "l", "s"], None, 0.6, weights, 2).collect():
            if r["__hf_epoch"] == 0:
                got[r.d, r.l, r.s] = r["__hf_quota"]
        for leaf, amount in want.items():
            assert got[leaf] == pytest.approx(amount, abs=1e-5), (case, leaf)


def test_same_seed_same_choice(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    def pick(d, seed):
        return sorted((str(r.doc_id), r["__hf_epoch"]) for r in mix(d, share=0.3, seed=seed).collect())
    assert pick(df, 1) == pick(df.repartition(9), 1)
    assert pick(df, 1) != pick(df, 2)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = mix(df)
    assert out.collect() == [] and out.columns[:6] == df.columns
    assert mix(spark.createDataFrame([(1, None, "d", "en", "s", 0)], SCHEMA)).collect() == []
