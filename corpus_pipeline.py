"""The corpus pipeline over ``documents``: five filtering and arranging stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but
the last return the columns of ``documents``.

Defined results of every stage: a null text counts as empty; rows without
an id, source or lang are rows like any other; repeated rows are copies, of
which the second stage keeps one; very long texts are read whole; further
columns of documents are passed on up to the last stage (their names must
not begin with ``__hf_``); ties are decided as in each stage's operator; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulframe.llm import dedup, ngram_join, packing, quality
from haulframe.llm.queries import mixture
from haulframe.llm.tables import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (operator 9); without labels of both kinds all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the longest original, then the smallest id, stays (operator 7)."""
    return dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 4); empty texts are no copies of each other by it."""
    return ngram_join.one_of_each(docs)


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to each source's token budget; three quarters of all tokens, no document twice, none without tokens (operator 10)."""
    return mixture(docs, share=0.75, max_epochs=1).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 1024 tokens (operator 6)."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing to target weights", target_mixture),
    ("best-fit packing", packed_sequences),
]

#: The first stage applies a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the table ``documents`` to pieces in sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
