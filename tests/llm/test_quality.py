"""Operator 9: held-out accuracy, folds, and the odd cases."""

import zlib

import numpy as np
import pytest

from haulframe.llm import quality
from tests.conftest import MEDIUM


def read(spark, name, sf=MEDIUM):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def scored(spark):
    out = quality.classify(read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1"))
    return out.join(read(spark, "labels", "/root/testdata/sf0.1"), "doc_id").toPandas()


def test_held_out_accuracy(scored):
    held = scored[scored.held_out]
    assert len(held) > 400
    assert (held.predicted == held.quality).mean() > 0.98
    assert held[held.quality == 1].predicted.mean() > 0.99


def test_scores_are_calibrated(scored):
    held = scored[scored.held_out]
    assert held.score.between(0, 1).all()
    assert abs(held.score.mean() - held.quality.mean()) < 0.03
    assert ((held.score >= 0.3) == (held.predicted == 1)).all()


def test_fold(scored):
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()


def test_only_the_fit_fold_is_learnt_from(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted(quality.classify(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    labels = read(spark, "labels").select("doc_id", "quality").union(spark.createDataFrame(
        [(None, 1), (1, None), (2, 7), (3, 0), (3, 1), (4, 1), (4, 1)], "doc_id bigint, quality int"))
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (1, None, 1), (2, "", 1), (3, "wort " * 300_000, 1), (4, "x" * 300_000, 1)],
                                 "doc_id bigint, text string, score int")
    model = quality.fit(read(spark, "documents"), labels)
    from pyspark.sql import functions as F
    out = docs.select("doc_id", model.column(F.col("text")).alias("s")).collect()
    assert len(out) == 6 and all(0 <= r.s <= 1 for r in out)
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 6  # without labels every score is 0.5
    only = quality.classify(docs, labels.where("quality = 1")).collect()
    assert {r.predicted for r in only} == {1} and len({r.score for r in only}) == 1
    assert quality.classify(docs.limit(0), labels).collect() == []


def plain_features(text, model):
    """The features of one text by plain loops."""
    rows = quality.Rows(model.words)
    tokens = text.split()
    v = [model.vectors[rows[w]].astype(float) for w in tokens]
    dims = model.vectors.shape[1]
    n = len(v)
    mean = [sum(x[i] for x in v) / n if n else 0.0 for i in range(dims)]
    spread = [max(sum(x[i] ** 2 for x in v) / n - mean[i] ** 2, 0) ** 0.5 if n else 0.0 for i in range(dims)]
    near = sum(float(a @ b) for a, b in zip(v, v[1:])) / max(n - 1, 1)
    repeats = sum(rows[a] == rows[b] for a, b in zip(tokens, tokens[1:])) / max(n - 1, 1)
    return np.array([*mean, *spread, near, np.log1p(n), len(set(tokens)) / max(n, 1), repeats])


def test_scores_against_plain_loops(spark):
    """Features, network and temperature of every document, recomputed without slices, batches or Spark."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = quality.fit(docs, labels)
    w1, b1, w2, b2 = (a.astype(float) for a in model.layers)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    for r in docs.collect()[::5]:
        x = (plain_features(r.text or "", model) - model.scale[0]) / model.scale[1]
        hidden = [np.tanh(sum(min(max(x[i], -8), 8) * w1[i][j] for i in range(len(x))) + b1[j]) for j in range(len(b1))]
        logit = float(sum(h * w for h, w in zip(hidden, w2)) + b2[0])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-logit / model.temperature))) < 2e-3, r.doc_id


def test_vectors_are_sums_over_all_documents(spark):
    """Vocabulary and word vectors of a small corpus by plain loops; unlabelled documents count."""
    texts = ["a b c a", "b a, c", None, "", "c c c", "d é a b"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels, vocabulary=3, dims=16, window=2)
    assert model.words == ["c", "a", "b"]
    index = quality.index_vectors(len(model.words) + quality.SHAPES * quality.SHARED, 16, 7)
    rows, want = quality.Rows(model.words), np.zeros_like(index, dtype=float)
    for t in texts:
        ids = [rows[w] for w in (t or "").split()]
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j and abs(i - j) <= 2:
                    want[a] += index[b]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(model.vectors, want, atol=1e-6)


def test_most_frequent_values(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    tokens = [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in tokens], "w string").repartition(5)
    order = sorted(Counter(tokens).items(), key=lambda x: (-x[1], x[0]))
    for most in (1, 7, 40, 500):
        assert [(r.w, r["count"]) for r in quality.most_frequent(df, most).collect()] == order[:most]


def test_a_sampled_id_counts_once(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i % 40} of {i}") for i in range(1200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    assert quality.sample(docs, labels, 20, "quality").count() == 20


def test_pooling_does_not_depend_on_the_slices():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(50, 8)).astype(np.float32)
    parts = [rng.integers(0, 50, n) for n in (0, 1, 250_000, 3, 0, 120_000)]
    ids = np.concatenate(parts).astype(np.int32)
    lengths = np.array([len(p) for p in parts])
    distinct = np.array([len(set(p.tolist())) for p in parts])
    got = quality.pooled(ids, lengths, distinct, vectors)
    for row, p in zip(got, parts):
        if len(p) < 2:
            continue
        v = vectors[p]
        want = np.r_[v.mean(0), v.std(0), (v[:-1] * v[1:]).sum(1).mean(), np.log1p(len(p)), len(set(p.tolist())) / len(p), (p[:-1] == p[1:]).mean()]
        assert np.allclose(row, want, atol=2e-3)


def test_temperature_flattens_overconfident_logits():
    rng = np.random.default_rng(1)
    truth = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-truth))).astype(float)
    assert 3 < quality.temperature(truth * 4, y) < 5


def test_lists_of_bounded_size_hold_every_text_once():
    texts = ["", "a" * 5, "b" * 30, "", "c", "d" * 9, "e"] * 300
    for chars in (1, 10, 1_000_000):
        parts = list(quality.spans(texts, chars))
        assert sum(parts, []) == texts and all(len(p) <= 512 for p in parts)
        assert all(len(p) == 1 or sum(map(len, p)) <= chars for p in parts)
    assert list(quality.spans([])) == []
