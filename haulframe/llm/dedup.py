"""Exact dedup by skew-safe combining (DataFrame functions only).

Texts are equal when their normal forms are identical.  Copies are combined
in three stages, and every stage groups by the full normal form next to its
digest, so a digest collision never merges different texts:

1. locally: the map side of the first aggregate keeps one row per normal
   form and task;
2. salted: its reduce side merges those rows per (digest, salt), the salt
   being the input partition, so the rows of a hot text meet in ``salts``
   groups instead of one;
3. globally: the at most ``salts`` salt winners of a text are combined.

The row with the longest original text stays, then the smallest id.

Defined results: a null text counts as empty (all empty texts are one
group); a null id is a row like any other and loses ties against every
id; rows equal in text length and id are tied completely, and exactly one
of them stays; very long texts are compared whole; an empty table gives an
empty result; other columns are not looked at.  Ids are integers (the
smallest wins by ``bitwise_not``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.tables import repeated, salt_of, with_salts, written

WHITE = r"[\x20\x09-\x0D]+"


def without_white_space(text: Column) -> Column:
    """The normal form of the query's contract: the text without ASCII white space."""
    return F.regexp_replace(text, WHITE, "")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                normal: Callable[[Column], Column] = without_white_space,
                digest: Callable[[Column], Column] = sha256_hex, salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chars_kept.

    ``digest`` only deals out the rows; any function of the normal form
    gives the same result.  ``salts`` bounds the rows of one text in the
    last stage and spreads the copies of a hot text over that many groups.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.length(text).alias("len"),
        normal(text).alias("content"),
        F.spark_partition_id().alias("part"),
    ).withColumn("digest", digest(F.col("content")))
    # max of (length, reversed id): ~id falls as id grows and cannot overflow; a null loses
    rank = F.struct(F.col("len"), F.bitwise_not(F.col("id")).alias("rid"))

    salted = (rows.withColumn("salt", F.pmod(F.col("part"), F.lit(salts)))
              .groupBy("digest", "salt", "content")
              .agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("best")))
    classes = (salted.repartition("digest")
               .groupBy("digest", "content")
               .agg(F.sum("n").alias("size"), F.max("best").alias("best")))
    found = written(_narrow(classes), "dedup-classes")

    several = found.groupBy("digest").count().where("count > 1").select("digest")
    clash = not several.isEmpty()
    if clash:
        several = written(several, "dedup-clashes")
    by_digest = found.join(several, "digest", "left_anti") if clash else found

    single = by_digest.where("size = 1").select(
        F.col("keep_id").alias("id"), "keep_id", "size", F.lit(True).alias("kept"), "sha", "best_len")
    joined = (rows.select("id", "len", "digest").withColumn("salt", salt_of(salts, "id", "len"))
              .join(with_salts(by_digest.where("size > 1"), salts, "salt"), ["digest", "salt"]))
    out = single.unionByName(_marked(joined))
    if clash:
        # different texts under one digest: their rows are matched by content
        doubtful = rows.join(several, "digest", "left_semi").select("id", "len", "digest", "content")
        exact = classes.join(several, "digest", "left_semi")
        exact = _narrow(exact, "content")
        out = out.unionByName(_marked(doubtful.join(exact, ["digest", "content"])))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), "kept",
                      F.col("sha").alias("text_sha256"), F.col("best_len").alias("n_chars_kept"))


def _narrow(classes: DataFrame, *more: str) -> DataFrame:
    return classes.select("digest", *more, F.col("size"), F.bitwise_not(F.col("best.rid")).alias("keep_id"),
                          F.col("best.len").alias("best_len"), sha256_hex(F.col("content")).alias("sha"))


def _marked(joined: DataFrame) -> DataFrame:
    """Rows with their class; of rows tied completely with the winner, one is kept."""
    key = ["id", "len", "keep_id", "size", "sha", "best_len"]
    alike = joined.groupBy("digest", *key).agg(F.count(F.lit(1)).alias("alike"))
    wins = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("best_len"))
    return (repeated(alike, "alike", "nth")
            .select("id", "keep_id", "size", (wins & (F.col("nth") == 1)).alias("kept"), "sha", "best_len"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = exact_dedup(docs, id_col, text_col, **options).where("kept").select(
        _key(F.col(id_col)).alias("__hf_id"), F.col("n_chars_kept").alias("__hf_len"), F.col("text_sha256").alias("__hf_sha"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = options.get("normal", without_white_space)
    keys = ["__hf_id", "__hf_len", "__hf_sha"]
    rows = docs.withColumns({"__hf_id": _key(F.col(id_col)), "__hf_len": F.length(text),
                             "__hf_sha": sha256_hex(normal(text))})
    # rows tied completely have the same keys; the join has brought them together already
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return (rows.join(decided, keys).withColumn("__hf_nth", nth).where("__hf_nth = 1")
            .select(*[rows[c] for c in docs.columns]))


def _key(c: Column) -> Column:
    """A join key that a null id has too."""
    return F.coalesce(c.cast("string"), F.lit(""))
