"""Stand-in views: the driver's TPC-H-like tables shaped as the product's inputs.

Which driver table stands for which product input is fixed in FIXTURES.md
section 3; every view here is a lazy DataFrame over the given tables, so its
work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.operators.broadcasts import checked_broadcast
from haulframe.sources.tables import Tables

# Fixed value of the shipment stand-in: delivered in time within a year.
SLA_DAYS = 365


def delivery_days(shipped: Column, ordered: Column, max_days: int | None = None) -> Column:
    """Days between order and shipment (either may come first in the driver's tables, so every line
    with both dates has a delivery time); over ``max_days``, when given, it does not count as valid."""
    d = F.abs(F.datediff(shipped.cast("date"), ordered.cast("date")))
    return d if max_days is None else F.when(d <= max_days, d)


def shipments(t: Tables) -> DataFrame:
    """client, route, carrier, reason, shipped_at, delivery_days.

    Join order keeps the line-item-sized data to two shuffles (one per
    line item key): orders are joined to their customer first (an
    orders-sized shuffle on the customer key), suppliers to their nation,
    and only then is each line joined on the order key and on the supplier
    key.  Nation (25 rows in this schema) is broadcast after a row-count
    check; any other side that turns out small at runtime is broadcast by AQE.
    """
    nation = checked_broadcast(t.nation.select("n_nationkey", "n_name"))
    sn = nation.select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("sn_name"))
    cn = nation.select(F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("cn_name"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    oc = (o.join(c, o.o_custkey == c.c_custkey).join(cn, F.col("c_nationkey") == F.col("cn_key"))
          .select("o_orderkey", "o_orderdate", "c_mktsegment", "cn_name"))
    s = (t.supplier.select("s_suppkey", "s_name", "s_nationkey").join(sn, F.col("s_nationkey") == F.col("sn_key"))
         .select("s_suppkey", "s_name", "sn_name"))
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
    return (
        li.join(oc, li.l_orderkey == oc.o_orderkey)
        .join(s, F.col("l_suppkey") == s.s_suppkey)
        .select(
            F.col("c_mktsegment").alias("client"),
            F.concat_ws(" -> ", "sn_name", "cn_name").alias("route"),
            F.col("s_name").alias("carrier"),
            F.col("l_returnflag").alias("reason"),
            F.col("l_shipdate").alias("shipped_at"),
            delivery_days(F.col("l_shipdate"), F.col("o_orderdate")).alias("delivery_days"),
        )
    )


SHIPMENTS_SQL = """
SELECT c.c_mktsegment AS client,
       sn.n_name || ' -> ' || cn.n_name AS route,
       su.s_name AS carrier,
       l.l_returnflag AS reason,
       l.l_shipdate AS shipped_at,
       abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))) AS delivery_days
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier su ON l.l_suppkey = su.s_suppkey
JOIN nation sn ON su.s_nationkey = sn.n_nationkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey
"""


def subscription_requests(t: Tables) -> DataFrame:
    """events as newsletter sign-ups: arrival, em_nl, cp_name, tp_area."""
    e = t.events.select("event_id", "user_id", "event_type")
    return e.select(
        F.col("event_id").alias("arrival"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("em_nl"),
        F.when(F.col("event_type").isin("view", "click"), F.lit(None).cast("string"))
        .otherwise(F.col("event_type")).alias("cp_name"),
        (F.col("user_id") % 3).cast("int").alias("tp_area"),
    )


SUBSCRIPTION_REQUESTS_SQL = """
SELECT event_id AS arrival,
       'user' || CAST(user_id AS VARCHAR) || '@example.com' AS em_nl,
       CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_type END AS cp_name,
       CAST(user_id % 3 AS INTEGER) AS tp_area
FROM events
"""


def payment_events(t: Tables) -> DataFrame:
    """events as payment webhook calls: purchase = completed, error = refunded."""
    e = t.events
    return e.select(
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_type") == "purchase", F.lit("checkout.session.completed"))
        .when(F.col("event_type") == "error", F.lit("charge.refunded"))
        .otherwise(F.concat(F.lit("other."), F.col("event_type"))).alias("type"),
        F.col("ts"),
        F.col("user_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"),
    )


def intervals(t: Tables) -> DataFrame:
    """events as closed intervals [ts, ts + value minutes] per user."""
    e = t.events.select("event_id", "user_id", "ts", "value")
    return e.select(
        "event_id", "user_id", F.col("ts").alias("start_ts"),
        F.timestamp_add("MICROSECOND", F.round(F.col("value") * 60_000_000).cast("bigint"), F.col("ts")).alias("end_ts"),
    )


def chart_series(t: Tables) -> DataFrame:
    """events as chart series: series = event_type, x = day, y = sum(value)."""
    e = t.events.select("ts", "event_type", "value")
    return e.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("x")).agg(
        F.sum("value").alias("y"))
