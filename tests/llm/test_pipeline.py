"""The pipeline: columns, each stage against its brute-force version on its own input."""

import importlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from tests.llm import test_dedup, test_ngram_join

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    found = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, found[-1], MEDIUM).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_columns_and_rows(steps):
    for before, after in zip(steps[:-2], steps[1:-1]):
        assert after.columns == before.columns
        assert after.exceptAll(before).isEmpty()
    assert 0 < steps[4].count() < steps[3].count() < steps[2].count() < steps[1].count() < steps[0].count()


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    kept = {r.doc_id for r in steps[1].select("doc_id").collect()}
    truth = labels.collect()
    assert sum(r.doc_id in kept for r in truth if r.quality == 1) >= 0.99 * sum(r.quality == 1 for r in truth)
    assert sum(r.doc_id in kept for r in truth if r.quality == 0) <= 0.02 * sum(r.quality == 0 for r in truth)


def test_dedup_stages(steps):
    rows = [(r.doc_id, r.text, None) for r in steps[1].collect()]
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(r[0] for r in test_dedup.brute(rows) if r[3])


def test_near_copies_stage(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    want = {c for _, c, _ in test_ngram_join.brute(rows)}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(want)


def test_mixture_stage(steps):
    words = {r.doc_id: len(r.text.split()) for r in steps[3].collect()}
    taken = [r.doc_id for r in steps[4].collect()]
    assert len(taken) == len(set(taken))
    share = sum(words[i] for i in taken) / sum(words.values())
    assert 0.75 <= share < 0.85


def test_packing_stage(steps):
    packed = steps[5].toPandas()
    assert sorted(set(packed.doc_id)) == sorted(r.doc_id for r in steps[4].select("doc_id").collect())
    assert (packed.groupby("sequence_id")["length"].sum() <= 1024).all()


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_empty_tables(spark, tmp_path, empty):
    """Nulls in every column, empty and very long texts, repeated rows, a further column of a clashing name."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(120)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    long = " ".join(f"long{i % 977} word{i}" for i in range(60_000))
    odd = spark.createDataFrame(
        [(None, "a text without an id, and so on and on", "en", "src1", 5), (900001, None, "en", "src1", None), (900002, "", None, None, 0),
         (900003, long, "de", None, 7), (900004, "only these few words", None, "src2", 1), (None, None, None, None, None)], docs.schema)
    rows = docs.union(odd).union(odd).withColumn("piece", F.lit("mine"))
    if empty:
        rows, labels = rows.limit(0), labels.limit(0)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        kept = pipeline.written(stage(spark, now, str(tmp_path)), "test")
        assert kept.columns == rows.columns
        assert kept.exceptAll(now).isEmpty(), name
        now = kept
    out = pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert out == []
    else:
        texts = {r.doc_id: r.text for r in now.collect()}
        assert {r.doc_id for r in out} == set(texts) and sum(r.length for r in out if r.doc_id == 900003) >= 60_000 * (900003 in texts)
