"""Merkle fixity audit of WARC replicas.

A replica is a table of records: file, offset, length, digest (of the
record's bytes).  Its tree has the records as leaves; the nodes of level 1
are ordered offset ranges of ``range_bytes``, each higher level joins
``fanout`` neighbours, up to one node per file, and from there ``fanout``
neighbouring files, up to the replica's root.  A node's hash covers its
children's keys and hashes in order.  Each level is one grouped
aggregation whose groups are bounded by the fanout (by the records of one
range on level 1), so no file and no replica is gathered in one task.

An audit compares the two roots and then, level by level, only the
children of nodes that differ.

Defined results: records are keyed by (file, offset); the same key twice
in a replica is one leaf over both (in order of their digests); a null
digest is a digest of its own; rows with a null file or offset take no
part; against an empty replica every record is missing; two equal (or two
empty) replicas give no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulframe.llm.tables import written
from haulframe.operators.positions import global_row_number

Levels = list[DataFrame]  # from the leaves to the root: file, node, up_file, up_node, hash, length


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record (nulls as empty)."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def digest_of(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def archive(pages: DataFrame, *, copy: Column | None = None, present: Column | None = None, file_records: int = 4096) -> DataFrame:
    """The index of an archive that holds ``pages`` in order of page_id, and its copy.

    file, offset, length, digest of each record, and copy_length,
    copy_digest of the record whose html is ``copy`` in the copy (null
    where ``present`` is false).  Files are runs of ``file_records``
    records, so an offset is a running sum over a bounded group.
    """
    def record(html: Column) -> Column:
        return warc_record(F.col("page_id"), F.col("url"), html)

    here = present if present is not None else F.lit(True)
    rows = pages.select(
        "page_id", record(F.col("html")).alias("record"),
        F.when(here, record(copy if copy is not None else F.col("html"))).alias("copied"))
    rows = rows.select("page_id", F.octet_length("record").cast("bigint").alias("length"), digest_of(F.col("record")).alias("digest"),
                       F.octet_length("copied").cast("bigint").alias("copy_length"), digest_of(F.col("copied")).alias("copy_digest"))
    # rows equal in all of these are interchangeable
    placed = global_row_number(rows, [F.col("page_id").asc_nulls_last(), F.col("digest"), F.col("copy_digest")])
    file = F.floor((F.col("position") - 1) / F.lit(file_records)).cast("bigint")
    before = F.sum("length").over(Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("file", file).select("file", F.coalesce(before, F.lit(0)).alias("offset"), "length", "digest",
                                                  "copy_length", "copy_digest", "page_id")


def tree(records: DataFrame, top: tuple[int, int], *, range_bytes: int = 65536, fanout: int = 16) -> Levels:
    """The levels of a replica's tree; ``top`` is (greatest offset, greatest file) of either replica."""
    kept = records.where(F.col("file").isNotNull() & F.col("offset").isNotNull())
    level = kept.groupBy("file", F.col("offset").alias("node")).agg(
        F.concat_ws("|", F.array_sort(F.collect_list(F.coalesce("digest", F.lit("null"))))).alias("hash"), F.sum("length").alias("length"))
    file, node = F.col("file"), F.floor(F.col("node") / range_bytes).cast("bigint")
    out, spans, files = [], top[0] // range_bytes + 1, top[1] + 1
    while True:
        out.append(written(level.select("file", "node", file.alias("up_file"), node.alias("up_node"), "hash", "length"), "merkle-level"))
        if out[1:] and spans == 1 and files == 1:
            return out
        if out[1:] and spans > 1:
            spans = -(-spans // fanout)
        elif out[1:]:
            files = -(-files // fanout)
        child = F.struct("file", "node", "hash")
        level = out[-1].groupBy(F.col("up_file").alias("file"), F.col("up_node").alias("node")).agg(
            F.sha2(F.to_json(F.array_sort(F.collect_list(child))).cast("binary"), 256).alias("hash"), F.sum("length").alias("length"))
        file, node = F.col("file"), F.col("node")
        if spans > 1:
            node = F.floor(F.col("node") / fanout).cast("bigint")
        else:
            file = F.floor(F.col("file") / fanout).cast("bigint")


def reach(*replicas: DataFrame) -> tuple[int, int]:
    """Greatest offset and file number of the replicas (two numbers)."""
    found = [r.agg(F.max("offset").alias("o"), F.max("file").alias("f")).first() for r in replicas]
    return max((x["o"] or 0 for x in found), default=0), max((x["f"] or 0 for x in found), default=0)


def audit(spark: SparkSession, left: Levels, right: Levels) -> DataFrame:
    """file, offset, length, other_length, kind of the records in which two replicas differ.

    kind: ``changed``, ``missing`` (only in ``left``) or ``extra`` (only in
    ``right``).
    """
    differing: DataFrame | None = None
    for a, b in zip(reversed(left), reversed(right)):
        if differing is not None:
            a, b = (x.join(differing, ["up_file", "up_node"], "left_semi") for x in (a, b))
        b = b.select("file", "node", F.col("hash").alias("other_hash"), F.col("length").alias("other_length"))
        both = a.join(b, ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other_hash")))
        both = written(both.select("file", "node", "hash", "other_hash", "length", "other_length"), "merkle-differing")
        differing = both.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
    kind = F.when(F.col("other_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    return both.select("file", F.col("node").alias("offset"), "length", "other_length", kind.alias("kind"))
