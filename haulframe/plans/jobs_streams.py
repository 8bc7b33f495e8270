"""Registered jobs: STM1-STM5.

Each job replays a driver table as a file stream in several deliveries
(ranges of event time, found from the data), drives the streaming query
after each delivery with an ``availableNow`` trigger, as a service that is
restarted between them, and returns the batch read of what the sink wrote.
Within a delivery the files are written in parallel.  The oracle
statements are the batch equivalents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.operators.totals import with_totals
from haulframe.plans import standins
from haulframe.plans.jobs_upserts import _SUBS_STATE_SQL, _subs_state
from haulframe.plans.registry import job
from haulframe.plans.standins import SUBSCRIPTION_REQUESTS_SQL
from haulframe.session import scratch_path
from haulframe.streaming import payments as pm

DELIVERIES = 4


def deliver(lines: DataFrame, run: Callable[[DataFrame], None]) -> None:
    """Replay ``lines`` (ts, value): after each delivery, ``run`` gets the text stream of all files so far.

    The lines are staged once, partitioned by delivery, and each delivery
    is a distributed copy of its partition into the stream's folder.  Lines
    without ts come with the first delivery.
    """
    spark = lines.sparkSession
    staged, source = scratch_path(spark, "deliveries"), scratch_path(spark, "stream-in")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    d = with_totals(lines.withColumn("_t", t), {"_first": F.min("_t"), "_last": F.max("_t")})
    nth = F.coalesce(F.floor((F.col("_t") - F.col("_first")) * DELIVERIES / (F.col("_last") - F.col("_first") + 1)), F.lit(0))
    d.select("value", (nth + F.coalesce("late", F.lit(0)) if "late" in lines.columns else nth).cast("int").alias("delivery")) \
        .write.partitionBy("delivery").parquet(staged)
    # one more when rows come late
    for k in range(DELIVERIES + ("late" in lines.columns)):
        spark.read.parquet(staged).where(F.col("delivery") == k).select("value").write.mode("append").text(source)
        run(spark.readStream.format("text").load(source))


def _payloads(t) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", "event_type", "value").select(
        "ts", pm.payload_column().alias("value"))


_ROUTE_SQL = f"""
SELECT CASE WHEN event_type = 'view' AND value < 5 THEN NULL ELSE 'evt_' || CAST(event_id AS VARCHAR) END AS id,
       CASE WHEN event_type = 'view' AND value < 5 THEN 'malformed'
            WHEN event_type = 'purchase' THEN 'payment' WHEN event_type = 'error' THEN 'refund'
            ELSE 'ignored' END AS route
FROM events
"""


@job("stm1_route_events", _ROUTE_SQL)
def stm1_route_events(t):
    """STM1: webhook payload stream routed into payment / refund / ignored / malformed."""
    out, ck = scratch_path(t.spark, "routed"), scratch_path(t.spark, "routed-ck")
    deliver(_payloads(t), lambda lines: pm.run_to_parquet(
        pm.route_events(pm.parse(lines)).select("id", "type", "created", "route"), out, ck, partition_by=["route"]))
    return t.spark.read.parquet(out).select("id", "route")


@job("stm2_dedupe_events", """
SELECT 'evt_' || CAST(event_id AS VARCHAR) AS id, ts AS created FROM events WHERE NOT (event_type = 'view' AND value < 5)
""")
def stm2_dedupe_events(t):
    """STM2: every event delivered twice, the second time one delivery later; each id comes out once."""
    out, ck = scratch_path(t.spark, "dedup"), scratch_path(t.spark, "dedup-ck")
    lines = _payloads(t).withColumn("late", F.explode(F.array(F.lit(0), F.lit(1))))

    def run(stream: DataFrame) -> None:
        pm.run_dedupe(pm.parse(stream).where(F.col("id").isNotNull()).select("id", "created"), out, ck, slots=2)

    deliver(lines, run)
    like = t.spark.createDataFrame([], "id string, created timestamp_ntz")
    stored = pm.stored_events(like, out, ["id", "created"])
    return (like if stored is None else stored).select("id", "created")


@job("stm3_payment_facts", """
SELECT 'evt_' || CAST(e.event_id AS VARCHAR) AS id, 'cs_' || CAST(e.event_id AS VARCHAR) AS session_id,
       CAST(e.user_id AS VARCHAR) AS user_ref, c.c_name AS customer_name, e.ts AS created,
       CAST(CAST(round(e.value * 100) AS BIGINT) / 100.0 AS DECIMAL(18,2)) AS amount,
       CASE WHEN c.c_name IS NULL THEN 'failed: unknown customer' ELSE 'ok' END AS status
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_acctbal >= 0
WHERE e.event_type = 'purchase'
""")
def stm3_payment_facts(t):
    """STM3: payments joined to the customer lookup (customers in debit are unknown)."""
    out, ck = scratch_path(t.spark, "facts"), scratch_path(t.spark, "facts-ck")
    sessions = t.customer.where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").cast("string").alias("user_ref"), F.col("c_name").alias("customer_name"))
    deliver(_payloads(t), lambda lines: pm.run_to_parquet(
        pm.payment_facts(pm.route_events(pm.parse(lines)), sessions), out, ck))
    return t.spark.read.parquet(out).drop("batch_id")


@job("stm4_running_counts", """
SELECT CAST(user_id AS VARCHAR) AS user_ref, count(*) AS requests FROM events WHERE event_type = 'signup' GROUP BY 1
""")
def stm4_running_counts(t):
    """STM4: running contact-request counter per user (signup events), final values."""
    out, ck = scratch_path(t.spark, "counts"), scratch_path(t.spark, "counts-ck")
    deliver(_payloads(t), lambda lines: pm.run_running_counts(
        pm.parse(lines).where(F.col("type") == "other.signup"), out, ck))
    return pm.latest_counts(t.spark, out)


@job("stm5_stream_subscriptions", f"""
WITH st AS ({_SUBS_STATE_SQL}),
rq AS ({SUBSCRIPTION_REQUESTS_SQL}),
r AS (SELECT arrival, lower(em_nl) AS email, lower(coalesce(nullif(cp_name, ''), 'none')) AS company,
             CASE WHEN tp_area = 1 THEN 'lo' WHEN tp_area = 2 THEN 'ki' ELSE '' END AS area FROM rq),
f AS (SELECT email, arg_min(area, arrival) AS first_area,
             arg_min(company, arrival) FILTER (WHERE company <> 'none') AS f_company,
             arg_min(area, arrival) FILTER (WHERE company <> 'none') AS f_area
      FROM r GROUP BY email),
n AS (SELECT coalesce(st.email, f.email) AS email, st.company AS company0, st.area AS area0, st.removed AS removed0,
             f.first_area, f.f_company, f.f_area, st.email IS NOT NULL AS stored,
             st.email IS NOT NULL AND lower(coalesce(st.company, 'none')) <> 'none' AS keep
      FROM st FULL OUTER JOIN f ON st.email = f.email)
SELECT email,
       CASE WHEN keep THEN company0 WHEN f_company IS NOT NULL THEN f_company
            WHEN stored THEN company0 ELSE 'none' END AS company,
       CASE WHEN keep THEN area0 WHEN f_company IS NOT NULL THEN f_area
            WHEN stored THEN area0 ELSE first_area END AS area,
       coalesce(removed0, false) AS removed
FROM n
""")
def stm5_stream_subscriptions(t):
    """STM5: sign-up requests streamed in arrival order into the bucketed subscription state."""
    spark = t.spark
    state_dir, ck = scratch_path(spark, "subs-state"), scratch_path(spark, "subs-ck")
    # delivered by arrival: the first request of an e-mail decides, and a request without a time has its place too
    lines = standins.subscription_requests(t).select(
        F.to_json(F.struct("arrival", "em_nl", "cp_name", "tp_area")).alias("value"), F.timestamp_micros("arrival").alias("ts"))
    schema = "arrival BIGINT, em_nl STRING, cp_name STRING, tp_area INT"

    def run(stream: DataFrame) -> None:
        pm.stream_subscriptions(spark, stream.select(F.from_json("value", schema).alias("r")).select("r.*"),
                                state_dir, _subs_state(t), ck)

    deliver(lines, run)
    return pm.read_subscriptions(spark, state_dir)
