"""A keyed table in versions: Parquet files per hash bucket and one manifest per version.

A change writes new files for the buckets it touches, under a folder of its
own, and then commits a manifest that names the files of every bucket.  The
commit is one rename, so a reader sees the version before or the version
after; files that no manifest names do not exist for it.  The manifest also
records the stream and the batch that made the version: a batch that is run
again is skipped.

Buckets are those of extendible hashing: a bucket of depth k holds the keys
whose hash ends in its k bits.  A bucket that would pass ``bucket_rows``
rows is split in the same write, so one task per bucket is one task per
bounded number of rows, however large the table becomes.  The driver
handles file names and counts only.

One writer at a time: a second one fails at the rename.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_ROWS = 1_000_000


@dataclass(frozen=True)
class Bucket:
    depth: int
    bits: int
    rows: int
    path: str | None  # None: no rows


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: list[Bucket]
    stream: str | None = None
    batch_id: int | None = None


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, key: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.key, self.bucket_rows = spark, root.rstrip("/"), key, bucket_rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests -------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of ``version`` (default: the latest), None for a table without versions."""
        have = self.versions()
        if not have:
            return None
        number = have[-1] if version is None else version
        source = self._fs.open(self._path(f"{self.root}/manifests/{number:012d}.json"))
        try:
            read = json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()
        return Manifest(read["version"], [Bucket(**b) for b in read["buckets"]], read["stream"], read["batch_id"])

    def _commit(self, m: Manifest) -> None:
        final = self._path(f"{self.root}/manifests/{m.version:012d}.json")
        aside = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            raise RuntimeError(f"version {m.version} of {self.root} was committed by another writer")

    # --- reading ---------------------------------------------------------

    def read(self, version: int | None = None, schema=None) -> DataFrame | None:
        """The rows of one version, whatever is committed later; None for a table without rows and without ``schema``."""
        m = self.manifest(version)
        paths = [b.path for b in m.buckets if b.path] if m else []
        return self._rows(paths, schema)

    def _rows(self, paths: list[str], schema) -> DataFrame | None:
        if not paths:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*paths)

    # --- writing ---------------------------------------------------------

    def create(self, rows: DataFrame) -> None:
        """Version 0, unless there is one already (a restart goes on from it)."""
        if not self.versions():
            n = rows.count()
            depth = max(0, math.ceil(math.log2(max(n, 1) / self.bucket_rows)))
            self._commit(Manifest(0, self._write(rows, {(depth, b) for b in range(2 ** depth)}, 0)))

    def apply(self, changes: DataFrame, change_key: Column, merge: Callable[[DataFrame, DataFrame], DataFrame], *,
              stream: str, batch_id: int) -> bool:
        """``merge(rows, changes)`` over the buckets that the keys of ``changes`` fall in; False for a batch done before.

        ``merge`` gets whole buckets and returns their new rows; it may add
        rows with keys of the changes, and drop rows.
        """
        m = self.manifest()
        if m.stream == stream and m.batch_id is not None and batch_id <= m.batch_id:
            return False
        # a micro-batch is computed once, for the buckets that it touches and for the merge
        changes = changes.persist()
        try:
            return self._apply(m, changes, change_key, merge, stream, batch_id)
        finally:
            changes.unpersist()

    def _apply(self, m: Manifest, changes: DataFrame, change_key: Column, merge: Callable, stream: str, batch_id: int) -> bool:
        keyed = changes.withColumn("__key", change_key)
        # at most one row per bucket
        touched = {(r["__slot"]["depth"], r["__slot"]["bits"]): r["n"] for r in keyed.groupBy(
            self._slot(F.col("__key"), {(b.depth, b.bits) for b in m.buckets}).alias("__slot")).agg(
            F.count_distinct("__key").alias("n")).collect()}
        at = {(b.depth, b.bits): b for b in m.buckets}
        rows = self._rows([at[s].path for s in touched if at[s].path], self._schema())
        slots = set()
        for (depth, bits), new in touched.items():
            more = max(0, math.ceil(math.log2(max(at[depth, bits].rows + new, 1) / self.bucket_rows)))
            slots |= {(depth + more, bits + (high << depth)) for high in range(2 ** more)}
        written = self._write(merge(rows, changes), slots, m.version + 1) if touched else []
        kept = [b for b in m.buckets if (b.depth, b.bits) not in touched]
        self._commit(Manifest(m.version + 1, kept + written, stream, batch_id))
        return True

    def _schema(self):
        """The columns of the table (an empty bucket has no file to tell them)."""
        return self.spark.read.parquet(f"{self.root}/data/empty").schema

    def _slot(self, key: Column, slots: set[tuple[int, int]]) -> Column:
        """The one of ``slots`` whose bits the key's hash ends in, as (depth, bits)."""
        h, out = F.xxhash64(key), F.lit(None).cast("struct<depth:int,bits:bigint>")
        for depth in sorted({d for d, _ in slots}):
            bits = h.bitwiseAND(F.lit((1 << depth) - 1))
            # depths differ by the splits only, so there are few of them; the bits are looked up in a hash set
            out = F.when(bits.isin([b for d, b in slots if d == depth]),
                         F.struct(F.lit(depth).alias("depth"), bits.alias("bits"))).otherwise(out)
        return out

    def _write(self, rows: DataFrame, slots: set[tuple[int, int]], version: int) -> list[Bucket]:
        """New files for ``slots``, one task each, and their counts."""
        if version == 0:
            rows.limit(0).write.mode("overwrite").parquet(f"{self.root}/data/empty")
        folder = f"{self.root}/data/{version:012d}-{uuid.uuid4().hex}"
        slot = self._slot(F.col(self.key), slots)
        labelled = rows.withColumn("__slot", F.concat_ws("-", slot["depth"], slot["bits"]))
        labelled.repartition(len(slots), "__slot").write.partitionBy("__slot").parquet(folder)
        # the column of the folder names alone: counts come from the files' footers
        have = {} if not self._has_files(folder) else {
            r["__slot"]: r["n"] for r in self.spark.read.schema(f"{_sql(rows)}, __slot string").parquet(folder)
            .groupBy("__slot").agg(F.count(F.lit(1)).alias("n")).collect()}
        return [Bucket(d, b, have.get(f"{d}-{b}", 0), f"{folder}/__slot={d}-{b}" if f"{d}-{b}" in have else None) for d, b in sorted(slots)]

    def _has_files(self, folder: str) -> bool:
        return any(s.isDirectory() and s.getPath().getName().startswith("__slot=") for s in self._fs.listStatus(self._path(folder)))

    def expire(self, keep: int = 2) -> int:
        """Delete manifests but the last ``keep`` and the files that only they, or no manifest, name; the number of folders."""
        have = self.versions()
        live = {b.path.rsplit("/", 1)[0] for v in have[-keep:] for b in self.manifest(v).buckets if b.path}
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v:012d}.json"), False)
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/data"))
                if s.getPath().getName() not in {p.rsplit("/", 1)[1] for p in live} | {"empty"}]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


def _sql(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
