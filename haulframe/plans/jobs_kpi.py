"""Registered jobs: KPI1-KPI7 and WIN4 (the monthly report slice)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from haulframe.operators import kpi
from haulframe.plans import standins
from haulframe.plans.registry import job
from haulframe.plans.standins import SHIPMENTS_SQL

# Fixed as-of instants for the dashboard figures (the events span January 2024).
EVENTS_AS_OF = dt.date(2024, 1, 15)


_KPI_BASE = f"""
WITH s AS ({SHIPMENTS_SQL}),
m AS (
  SELECT client, CAST(date_trunc('month', shipped_at) AS DATE) AS month,
         count(*) AS shipments,
         round(avg(delivery_days), 1) AS avgdelivery,
         CAST(round(100 * avg(CASE WHEN delivery_days IS NULL THEN NULL
                                   WHEN delivery_days <= 365 THEN 1.0 ELSE 0.0 END)) AS BIGINT) AS ontimedelivery
  FROM s GROUP BY ALL
),
pc AS (
  SELECT m.*, CAST(CASE WHEN p.shipments IS NULL OR p.shipments = 0 THEN NULL
                        ELSE round(100.0 * (m.shipments - p.shipments) / p.shipments) END AS BIGINT) AS percent_change
  FROM m LEFT JOIN m p ON m.client = p.client AND m.month = CAST(p.month + INTERVAL 1 MONTH AS DATE)
),
lc AS (
  SELECT client, CAST(date_trunc('month', shipped_at) AS DATE) AS month, reason, count(*) AS late_count
  FROM s WHERE delivery_days > 365 GROUP BY ALL
),
lr AS (
  SELECT *, row_number() OVER (PARTITION BY client, month ORDER BY late_count DESC, reason ASC) AS rank FROM lc
),
rates AS (
  SELECT client, 'route' AS dim, route AS name, count(*) AS n, sum(CASE WHEN delivery_days > 365 THEN 1 ELSE 0 END) AS late
  FROM s WHERE delivery_days IS NOT NULL GROUP BY client, route
  UNION ALL
  SELECT client, 'carrier', carrier, count(*), sum(CASE WHEN delivery_days > 365 THEN 1 ELSE 0 END)
  FROM s WHERE delivery_days IS NOT NULL GROUP BY client, carrier
),
best AS (
  SELECT client, dim, name, late * 1.0 / n AS rate,
         row_number() OVER (PARTITION BY client, dim ORDER BY late * 1.0 / n DESC, name ASC) AS rn
  FROM rates WHERE n >= 5
),
sugg AS (
  SELECT c.client,
         r.name AS route, round(r.rate, 4) AS route_late_rate,
         k.name AS carrier, round(k.rate, 4) AS carrier_late_rate
  FROM (SELECT DISTINCT client FROM s) c
  LEFT JOIN best r ON r.client = c.client AND r.dim = 'route' AND r.rn = 1
  LEFT JOIN best k ON k.client = c.client AND k.dim = 'carrier' AND k.rn = 1
)
"""


KPI1_SELECT = """
SELECT pc.client AS client_name, pc.month, pc.shipments, pc.avgdelivery, pc.percent_change, pc.ontimedelivery,
       d.delayreasons,
       CASE WHEN concat_ws(', ', sugg.route, sugg.carrier) = '' THEN NULL
            ELSE concat_ws(', ', sugg.route, sugg.carrier) END AS suggested
FROM pc
LEFT JOIN (SELECT client, month, string_agg(reason, ', ' ORDER BY rank) AS delayreasons
           FROM lr WHERE rank <= 3 GROUP BY client, month) d
  ON d.client = pc.client AND d.month = pc.month
LEFT JOIN sugg ON sugg.client = pc.client
"""
KPI_BASE_SQL = _KPI_BASE


@job("kpi1_monthly_report", _KPI_BASE + KPI1_SELECT)
def kpi1_monthly_report(t):
    """KPI1: monthly report per client (shipments, delivery, change, on-time, reasons, suggestion)."""
    return kpi.monthly_report(standins.shipments(t))


@job("kpi2_delay_reasons", _KPI_BASE + "SELECT client, month, reason, late_count, rank FROM lr WHERE rank <= 3")
def kpi2_delay_reasons(t):
    """KPI2: top-3 delay reasons per client and month."""
    return kpi.delay_reasons(standins.shipments(t), 3)


@job("kpi3_suggest", _KPI_BASE + "SELECT * FROM sugg")
def kpi3_suggest(t):
    """KPI3: worst route and carrier per client (support >= 5)."""
    return kpi.suggest(standins.shipments(t), 5)


@job("kpi4_net_payments", """
SELECT CAST(ts AS DATE) AS day,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) / 100.0 AS DECIMAL(18,2)) AS paid,
       CAST(sum(CASE WHEN event_type = 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) / 100.0 AS DECIMAL(18,2)) AS refunded,
       CAST((sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END)
           - sum(CASE WHEN event_type = 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END)) / 100.0 AS DECIMAL(18,2)) AS net
FROM events GROUP BY 1
""")
def kpi4_net_payments(t):
    """KPI4: payments minus refunds per day."""
    return kpi.net_payments(standins.payment_events(t))


@job("kpi5_call_queue", """
WITH calls AS (
  SELECT event_id AS call_id, CAST(user_id AS BIGINT) AS client_id, ts AS date_requested,
         (CAST(floor(value) AS BIGINT) % 2 = 0) AS called
  FROM events WHERE event_type = 'signup'
)
SELECT call_id, client_id, c.c_name AS company, 'tel-' || CAST(c.c_custkey AS VARCHAR) AS phone, date_requested,
       date_diff('day', CAST(date_requested AS DATE), DATE '2024-02-01') AS age_days
FROM calls JOIN customer c ON c.c_custkey = calls.client_id
WHERE NOT called
""")
def kpi5_call_queue(t):
    """KPI5: pending call queue with age (signup events as call requests, customers as clients)."""
    calls = t.events.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("client_id"),
        F.col("ts").alias("date_requested"), (F.floor("value") % 2 == 0).alias("called"))
    clients = t.customer.select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("company"),
                                F.concat(F.lit("tel-"), F.col("c_custkey").cast("string")).alias("phone"))
    return kpi.call_queue(calls, clients, dt.datetime(2024, 2, 1))


@job("kpi6_visitors", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
f AS (SELECT user_id, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY user_id)
SELECT CAST(dayofweek(day) + 1 AS INTEGER) AS weekday, count(*) AS total,
       sum(CASE WHEN day > first_day THEN 1 ELSE 0 END) AS returning
FROM d JOIN f USING (user_id) GROUP BY 1
""")
def kpi6_visitors(t):
    """KPI6: total vs returning visitors per weekday (1 = Sunday)."""
    return kpi.visitors(t.events)


@job("kpi7_period_compare", """
SELECT CAST(floor(hour(ts) / 4) * 4 AS INTEGER) AS slot_start,
       sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN 1 ELSE 0 END) AS today_count,
       sum(CASE WHEN CAST(ts AS DATE) <> DATE '2024-01-15' THEN 1 ELSE 0 END) AS previous_count,
       round(sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN value ELSE 0.0 END), 2) AS today_value,
       round(sum(CASE WHEN CAST(ts AS DATE) <> DATE '2024-01-15' THEN value ELSE 0.0 END), 2) AS previous_value
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-15'
GROUP BY 1
""")
def kpi7_period_compare(t):
    """KPI7: today vs previous day by 4-hour slot."""
    return kpi.period_compare(t.events, EVENTS_AS_OF)


@job("win4_percent_change", """
WITH m AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders
           FROM orders GROUP BY ALL)
SELECT m.o_orderstatus, m.month, m.orders,
       CAST(CASE WHEN p.orders IS NULL OR p.orders = 0 THEN NULL
                 ELSE round(100.0 * (m.orders - p.orders) / p.orders) END AS BIGINT) AS percent_change
FROM m LEFT JOIN m p ON p.o_orderstatus = m.o_orderstatus AND m.month = CAST(p.month + INTERVAL 1 MONTH AS DATE)
""")
def win4_percent_change(t):
    """WIN4: month-over-month change of the order count per order status."""
    m = t.orders.groupBy("o_orderstatus", F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"))
    return kpi.percent_change(m, "o_orderstatus", "month", "orders")
