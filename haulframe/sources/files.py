"""SRC2-SRC4: route-file reads and upload gates.

Gates run over a manifest table (one row per file: name, size, type and a
batch key); ``file_manifest`` lists a folder as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.operators.nullsafe import join_on

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# Route files accepted by the report form, and the size limit (20 MB).
ROUTE_FILE_TYPES = [
    "application/vnd.ms-excel",
    "text/csv",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
]
ROUTE_FILE_MAX_BYTES = 20971520
# Upload widget messages, in the order the checks run.
MSG_MAX_FILES = "Maximum number of files exceeded"
MSG_TYPE = "File type not allowed"
MSG_TOO_LARGE = "File is too large"
MSG_TOO_SMALL = "File is too small"
# ---------------------------------------------------------------------------

CORRUPT = "_corrupt_record"


def read_routes(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """SRC2: typed CSV read; records that do not fit the schema are kept apart.

    Returns (good rows, bad rows with the raw record).  Records, not lines,
    are read: a quoted cell may hold line ends and doubled quotes.  All
    columns of a record are parsed, so whether it is good does not depend
    on the columns the caller goes on to use.  A file is read by one task;
    the upload gate bounds a file's size (``ROUTE_FILE_MAX_BYTES``).
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    rows = (spark.read.schema(full).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path))
    names = [f.name for f in schema.fields]
    # only columns that the plan needs are converted, so the conditions need them all: this part of them always holds
    whole = F.xxhash64(*names).bitwiseOR(F.lit(1)) != 0
    good = rows.where(F.col(CORRUPT).isNull() & whole).select(*names)
    bad = rows.where(F.col(CORRUPT).isNotNull() & whole).select(F.col(CORRUPT).alias("raw_line"), *names)
    return good, bad


# Content types by file name ending, as browsers send them.
CONTENT_TYPES = {
    "csv": "text/csv", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "txt": "text/plain", "pdf": "application/pdf", "html": "text/html", "json": "application/json", "zip": "application/zip",
}


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC3, SRC4: the files under ``path``, however deep: batch (their folder), name, size, modified, content_type.

    Files are listed, not read: without its content column the
    ``binaryFile`` source opens none; empty files have nothing to take in
    and are not listed.  The content type follows from the ending of the
    name, null for an unknown one.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    name = F.element_at(parts, -1)
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit(None).cast("string")
    for known, mime in CONTENT_TYPES.items():
        kind = F.when(ending == known, F.lit(mime)).otherwise(kind)
    return found.select(F.element_at(parts, -2).alias("batch"), name.alias("name"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"), kind.alias("content_type"))


def gate_files(manifest: DataFrame, types: list[str] = ROUTE_FILE_TYPES,
               max_bytes: int = ROUTE_FILE_MAX_BYTES) -> DataFrame:
    """SRC3: accept a file when its type is allowed and its size within the limit.

    A known but unlisted type -> 'unsupported_type'; an allowed type over
    the limit -> 'too_large'; a file without a type passes unchecked.
    """
    t = F.col("content_type")
    reason = (F.when(t.isNull(), F.lit(None))
              .when(~t.isin(types), F.lit("unsupported_type"))
              .when(F.col("size") > max_bytes, F.lit("too_large")))
    return manifest.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def gate_batch(manifest: DataFrame, max_files: int | None, pattern: str | None, max_bytes: int | None,
               min_bytes: int | None, existing: Column | None = None) -> DataFrame:
    """SRC4: upload checks per batch, first failing check wins.

    Order: file count of the batch (plus files already there), type (the
    pattern must match the type or the name), maximum size, minimum size.
    The batch size is a windowed count over the batch key; Spark computes it
    as a partial aggregate per batch.
    """
    counts = manifest.groupBy("batch").agg(F.count(F.lit(1)).alias("_batch_files"))
    m = join_on(manifest, counts, ["batch"])
    have = existing if existing is not None else F.lit(0)
    err = F.lit(None).cast("string")
    checks = []
    if max_files is not None:
        checks.append((have + F.col("_batch_files") > max_files, MSG_MAX_FILES))
    if pattern:
        ok = F.coalesce(F.col("content_type").rlike(pattern), F.lit(False)) | F.coalesce(
            F.col("name").rlike(pattern), F.lit(False))
        checks.append((~ok, MSG_TYPE))
    if max_bytes is not None:
        checks.append((F.col("size") > max_bytes, MSG_TOO_LARGE))
    if min_bytes is not None:
        checks.append((F.col("size") < min_bytes, MSG_TOO_SMALL))
    for cond, msg in reversed(checks):
        err = F.when(cond, F.lit(msg)).otherwise(err)
    return m.withColumn("error", err).withColumn("accepted", F.col("error").isNull()).drop("_batch_files")

