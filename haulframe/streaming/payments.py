"""STM1-STM5: the payment webhook and subscription intake as Structured Streaming jobs.

Sources are file streams of JSON payloads (a message bus would be the
same ``readStream`` with another format).  Sinks are ``foreachBatch``
writes keyed by the micro-batch id: a re-executed batch overwrites its own
output folder, so a retried batch has exactly-once effect.  Checkpoints and
outputs live under the session's shared checkpoint folder.  Streams that
keep state (STM2, STM4) keep it in a state store with snapshots under their
checkpoint; tables that streams update (STM4, STM5) are versioned
(``streaming/versions.py``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.operators.upserts import upsert_subscriptions
from haulframe.streaming.versions import BUCKET_ROWS, VersionedTable

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: webhook event types.
EVENT_PAYMENT = "checkout.session.completed"
EVENT_REFUND = "charge.refunded"
# ---------------------------------------------------------------------------

# Event times travel with microseconds (the JSON default keeps milliseconds).
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("created", T.TimestampNTZType()),
    T.StructField("data", T.StructType([
        T.StructField("object", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("amount_total", T.LongType()),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        ])),
    ])),
])


def payload_column() -> Column:
    """JSON webhook payload of one events row (event_id, ts, user_id, event_type, value)."""
    typ = (F.when(F.col("event_type") == "purchase", F.lit(EVENT_PAYMENT))
           .when(F.col("event_type") == "error", F.lit(EVENT_REFUND))
           .otherwise(F.concat(F.lit("other."), F.col("event_type"))))
    obj = F.struct(F.concat(F.lit("cs_"), F.col("event_id").cast("string")).alias("id"),
                   F.round(F.col("value") * 100).cast("bigint").alias("amount_total"),
                   F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("metadata"))
    body = F.to_json(F.struct(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"), typ.alias("type"),
                              F.col("ts").alias("created"), F.struct(obj.alias("object")).alias("data")),
                     JSON_OPTIONS)
    # a truncated delivery stands for a payload that fails to parse
    broken = (F.col("event_type") == "view") & (F.col("value") < 5)
    return F.when(broken, F.substring(body, 1, 20)).otherwise(body)


def payloads_from_events(events: DataFrame) -> DataFrame:
    """The events table replayed as webhook payload lines (one JSON text per event)."""
    return events.select(payload_column().alias("value"))


def parse(stream: DataFrame) -> DataFrame:
    """Text lines -> typed payload columns; unparsable lines get route 'malformed'."""
    p = stream.select(F.col("value").alias("raw"), F.from_json("value", PAYLOAD_SCHEMA, JSON_OPTIONS).alias("e"))
    return p.select("raw", F.col("e.id").alias("id"), F.col("e.type").alias("type"),
                    F.col("e.created").alias("created"),
                    F.col("e.data.object.id").alias("session_id"),
                    F.col("e.data.object.amount_total").alias("amount_total"),
                    F.col("e.data.object.metadata").getItem("user_id").alias("user_ref"))


def route_events(parsed: DataFrame) -> DataFrame:
    """STM1: completed -> payment, refunded -> refund, other types ignored, unparsable -> malformed."""
    route = (F.when(F.col("id").isNull() | F.col("type").isNull(), F.lit("malformed"))
             .when(F.col("type") == EVENT_PAYMENT, F.lit("payment"))
             .when(F.col("type") == EVENT_REFUND, F.lit("refund")).otherwise(F.lit("ignored")))
    return parsed.withColumn("route", route)


#: What a stored event is placed by: its day, and a hash of its id.
PLACES = "day string, slot int, batch_id bigint"
SLOTS = 4


def _place(id_col: str, time_col: str, slots: int) -> dict[str, Column]:
    # a redelivered event carries the time it was made, so it falls into the same place; the year 0 holds those without one
    return {"day": F.date_format(F.coalesce(F.col(time_col).cast("date"), F.lit("0000-01-01").cast("date")), "yyyy-MM-dd"),
            "slot": F.pmod(F.xxhash64(id_col), F.lit(slots)).cast("int")}


def run_dedupe(stream: DataFrame, out_dir: str, checkpoint: str, id_col: str = "id", time_col: str = "created", *,
               arrived: Column | None = None, near: str = "2 days", slots: int = SLOTS) -> None:
    """STM2: store each event once, however often, late or in which micro-batch it is delivered again.

    The near past is kept as stream state: ids that arrived within ``near``
    drop their repeats (``dropDuplicatesWithinWatermark``).  The watermark
    follows the time of arrival, not the time of the event, so no row is
    ever too late for it and none is lost.

    An event cannot have arrived before it was made.  So one made within
    ``near`` of its arrival is known to the state, and only older ones are
    looked up among the stored ids: in the folders of their own days and id
    hashes.  What a batch reads follows from the late rows in it, not from
    the length of the history.  A batch that is run again leaves its own
    folder out of the comparison and overwrites it.
    """
    columns = stream.columns
    late = F.col("__arrived") - F.expr(f"INTERVAL {near}") > F.coalesce(F.col(time_col).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = stream.withColumn("__arrived", F.current_timestamp() if arrived is None else arrived).withWatermark("__arrived", near)
    once = rows.dropDuplicatesWithinWatermark([id_col]).withColumn("__late", late).withColumns(_place(id_col, time_col, slots))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            # names of folders: at most days x slots of the late rows
            places = [(r.day, r.slot) for r in batch.where("__late").select("day", "slot").distinct().collect()]
            fresh = batch
            if places and (stored := stored_events(batch, out_dir, columns, batch_id, places)) is not None:
                fresh = batch.join(stored.select(F.col(id_col), F.lit(True).alias("__late")), [id_col, "__late"], "left_anti")
            fresh.select(*columns, "day", "slot").repartition("day", "slot").write.mode("overwrite").partitionBy("day", "slot") \
                .parquet(f"{out_dir}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    with stateful(stream.sparkSession):
        drive(once.writeStream.foreachBatch(write), checkpoint)


def stored_events(like: DataFrame, out_dir: str, columns: list[str], before: int | None = None,
                  places: list[tuple[str, int]] | None = None) -> DataFrame | None:
    """The events that batches ``before`` have stored, in ``places`` only (day, slot); None before the first batch.

    Both conditions are on folder names, so other folders are not read.
    """
    spark = like.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    schema = T.StructType([like.schema[c] for c in columns] + T.StructType.fromDDL(PLACES).fields)
    stored = spark.read.schema(schema).parquet(out_dir)
    if before is not None:
        stored = stored.where(F.col("batch_id") < before)
    if places is not None:
        stored = stored.where(F.concat_ws("/", "day", "slot").isin([f"{d}/{s}" for d, s in places]))
    return stored


def drive(writer, checkpoint: str) -> None:
    """Run a stream over all files present now and wait for its end."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Settings of a stateful stream: its state lives in RocksDB, snapshots of it under the stream's checkpoint.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def stateful(spark: SparkSession, conf: dict[str, str] = STATE_CONF) -> Iterator[None]:
    """The settings under which stateful streams start; the caller's come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def payment_facts(routed: DataFrame, sessions: DataFrame) -> DataFrame:
    """STM3: payment rows joined to the static session lookup; a failure row when the lookup misses.

    sessions: user_ref (string), customer_name.  amount = cents / 100 as decimal.
    """
    pay = routed.where(F.col("route") == "payment")
    j = pay.join(sessions, "user_ref", "left")
    return j.select("id", "session_id", "user_ref", "customer_name", "created",
                    (F.col("amount_total").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("amount"),
                    F.when(F.col("customer_name").isNull(), F.lit("failed: unknown customer"))
                    .otherwise(F.lit("ok")).alias("status"))


def _batch_sink(out_dir: str, partition_by: list[str] | None = None):
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{out_dir}/batch_id={batch_id}")
    return write


def run_to_parquet(stream: DataFrame, out_dir: str, checkpoint: str, partition_by: list[str] | None = None,
                   output_mode: str = "append") -> None:
    """Drive a stream to completion over the files present now (``availableNow``)."""
    drive(stream.writeStream.outputMode(output_mode).foreachBatch(_batch_sink(out_dir, partition_by)), checkpoint)


COUNTS = "user_ref string, requests bigint"


def run_running_counts(stream: DataFrame, out_dir: str, checkpoint: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """STM4: running contact-request counter per user.

    The counts are the state of a streaming aggregate; in update mode a
    batch emits the new totals of the users it touched, and they replace
    those users' rows in the counter table (``VersionedTable``).  No batch
    reads earlier events or counts of users it does not touch, and totals
    written twice are the same totals.
    """
    spark = stream.sparkSession
    table = VersionedTable(spark, out_dir, "user_ref", bucket_rows)
    table.create(spark.createDataFrame([], COUNTS))

    def merge(rows: DataFrame, totals: DataFrame) -> DataFrame:
        return rows.join(totals, "user_ref", "left_anti").unionByName(totals)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not table.apply(batch, F.col("user_ref"), merge, stream=checkpoint, batch_id=batch_id):
            batch.write.format("noop").mode("overwrite").save()  # done before, but the state store has yet to commit the batch

    totals = stream.where(F.col("user_ref").isNotNull()).groupBy("user_ref").agg(F.count(F.lit(1)).alias("requests"))
    with stateful(spark):
        drive(totals.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def latest_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The counter table: one row per user."""
    return VersionedTable(spark, out_dir, "user_ref").read(schema=COUNTS)


SUBSCRIPTIONS = "email string, company string, area string, removed boolean"


def stream_subscriptions(spark: SparkSession, stream: DataFrame, state_dir: str, initial: DataFrame,
                         checkpoint: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """STM5: each micro-batch of sign-up requests is applied to the stored state (UPS1).

    The state is a ``VersionedTable`` keyed by e-mail: a batch reads and
    writes the buckets its requests fall in, and one manifest commit makes
    its version visible.  A run that ends before the commit leaves the old
    version; a batch that is run again is known by its recorded id.
    """
    table = VersionedTable(spark, state_dir, "email", bucket_rows)
    table.create(initial)

    def merge(rows: DataFrame, requests: DataFrame) -> DataFrame:
        return upsert_subscriptions(rows, requests)[1].drop("action")

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, F.lower("em_nl"), merge, stream=checkpoint, batch_id=batch_id)

    drive(stream.writeStream.foreachBatch(apply), checkpoint)


def read_subscriptions(spark: SparkSession, state_dir: str, version: int | None = None) -> DataFrame:
    return VersionedTable(spark, state_dir, "email").read(version, SUBSCRIPTIONS)
