"""Operator 4: links and classes against all pairs."""

import random
import re

import numpy as np
import pytest

from haulframe.llm import ngram_join as nj


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """Per row: (id, class id, links)."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            common = len(sets[i] & sets[j])
            if same or common and common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], least[top(i)], links[i]) for i in range(len(rows))), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for group in range(12):
        base = rng.choices(words, k=rng.randint(60, 200))
        for _ in range(rng.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One, two!"), (n + 4, "..."), (None, rows[0][1]), (7, rows[7][1]),
             (n + 5, " ".join(rng.choices(words, k=20_000)))]
    return rows


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_against_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(nj, "BLOCK_ROWS", block_rows)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, key string").repartition(5)
    assert got(nj.ngram_join(df, recall=0.99999)) == brute(rows)


def test_one_of_each(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, key string").repartition(5)
    kept = nj.one_of_each(df, recall=0.99999)
    assert kept.columns == df.columns
    classes = {}
    for r in nj.ngram_join(df, recall=0.99999).collect():
        classes[r.doc_id] = r.class_id
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and sorted(ids) == sorted(set(classes.values()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert nj.ngram_join(df).collect() == []
    assert nj.one_of_each(df).collect() == []


def test_bands_follow_from_the_recall():
    for recall in (0.9, 0.99, 0.9995):
        bands, rows = nj.plan_bands(0.8, recall)
        assert bands * rows <= 128 and 1 - (1 - 0.8 ** rows) ** bands >= recall


def test_measured_recall(spark):
    """Pairs at 0.8 to 0.85 share a band hash as often as planned."""
    rng = np.random.default_rng(0)
    bands, rows = nj.plan_bands(0.8, 0.99)
    factors = nj._factors(bands * rows)
    hit = 0
    for _ in range(400):
        x = rng.integers(0, 2 ** 63, 110, dtype=np.uint64)
        a, b = np.unique(x[:100]), np.unique(x[11:])  # 89 of 110 in common
        hit += bool((nj.band_hashes(a, bands, rows, factors) == nj.band_hashes(b, bands, rows, factors)).any())
    assert hit >= 0.97 * 400


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200), dtype=np.uint64)) for _ in range(90)]
    found = nj.common_counts(sets)
    for i in range(90):
        for j in range(i + 1, 90):
            assert found[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1005), (1005, 1001), (7000, 7000)]
    out = {r.node: r.root for r in nj.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert all(out[i] == 0 for i in range(301)) and out[1005] == out[1001] == out[1000] == 1000 and out[7000] == 7000
