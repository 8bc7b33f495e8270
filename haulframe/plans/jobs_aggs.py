"""Registered jobs: AGG1-AGG15."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from haulframe.operators import aggs
from haulframe.operators.filters import search
from haulframe.plans import standins
from haulframe.plans.registry import job

SERIES_SQL = "SELECT event_type AS series, CAST(ts AS DATE) AS x, sum(value) AS y FROM events GROUP BY 1, 2"


@job("agg1_series_totals", f"""
SELECT series, round(sum(y), 2) AS total FROM ({SERIES_SQL}) GROUP BY series
""")
def agg1_series_totals(t):
    """AGG1: total per chart series (event type)."""
    return aggs.series_totals(standins.chart_series(t)).withColumn("total", F.round("total", 2))


@job("agg2_stacked_totals", f"""
SELECT x, round(sum(y), 2) AS stacked_total FROM ({SERIES_SQL}) WHERE series NOT IN ('view') GROUP BY x
""")
def agg2_stacked_totals(t):
    """AGG2: stacked total per day over the non-excluded series."""
    return aggs.stacked_totals(standins.chart_series(t), exclude=["view"]).withColumn(
        "stacked_total", F.round("stacked_total", 2))


@job("agg3_stacked_by_group", f"""
SELECT CASE WHEN series IN ('purchase', 'error') THEN 'money' ELSE 'traffic' END AS stack_group, x,
       round(sum(y), 2) AS stacked_total
FROM ({SERIES_SQL}) WHERE series IN ('purchase', 'error', 'view', 'click') GROUP BY 1, 2
""")
def agg3_stacked_by_group(t):
    """AGG3: stacked totals per declared series group (signup belongs to none)."""
    groups = {"purchase": "money", "error": "money", "view": "traffic", "click": "traffic"}
    return aggs.stacked_totals_by_group(standins.chart_series(t), groups).withColumn(
        "stacked_total", F.round("stacked_total", 2))


@job("agg4_percent_share", """
WITH c AS (SELECT o_orderpriority AS x, o_orderstatus AS series, count(*) AS y FROM orders GROUP BY 1, 2),
xt AS (SELECT x, sum(y) AS t FROM c GROUP BY x)
SELECT c.x, c.series, c.y,
       round(CASE WHEN xt.t = 0 THEN 0.0 ELSE 100.0 * c.y / xt.t END, 4) AS share_of_x,
       round(100.0 * c.y / (SELECT sum(y) FROM c), 4) AS share_of_total
FROM c JOIN xt USING (x)
""")
def agg4_percent_share(t):
    """AGG4: status share within each priority (100 % stacked) and of all orders (pie)."""
    c = t.orders.groupBy(F.col("o_orderpriority").alias("x"), F.col("o_orderstatus").alias("series")).agg(
        F.count(F.lit(1)).alias("y"))
    r = aggs.percent_share(c, "x", "y", "series")
    return r.select("x", "series", "y", F.round("share_of_x", 4).alias("share_of_x"),
                    F.round("share_of_total", 4).alias("share_of_total"))


@job("agg5_totals_in_range", f"""
SELECT series, round(sum(y), 2) AS total FROM ({SERIES_SQL})
WHERE x > DATE '2024-01-05' AND x < DATE '2024-01-20' GROUP BY series
""")
def agg5_totals_in_range(t):
    """AGG5: totals per series inside the open day range (Jan 5, Jan 20)."""
    r = aggs.totals_in_range(standins.chart_series(t), dt.date(2024, 1, 5), dt.date(2024, 1, 20))
    return r.withColumn("total", F.round("total", 2))


@job("agg6_value_range", """
SELECT l_returnflag, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value
FROM lineitem GROUP BY ROLLUP (l_returnflag)
""")
def agg6_value_range(t):
    """AGG6: min/max price per return flag and overall."""
    return aggs.value_range(t.lineitem, "l_returnflag", "l_extendedprice")


@job("agg7_stacked_pos_neg", """
SELECT c_mktsegment, c_nationkey, round(sum(greatest(c_acctbal, 0.0)), 2) AS positive,
       round(sum(least(c_acctbal, 0.0)), 2) AS negative
FROM customer GROUP BY 1, 2
""")
def agg7_stacked_pos_neg(t):
    """AGG7: positive and negative account balance stacks per segment and nation."""
    r = aggs.stacked_pos_neg(t.customer, "c_mktsegment", "c_nationkey", "c_acctbal")
    return r.select("c_mktsegment", "c_nationkey", F.round("positive", 2).alias("positive"),
                    F.round("negative", 2).alias("negative"))


@job("agg8_group_rows", """
SELECT n_nationkey, n_name, n_regionkey,
       count(*) OVER (PARTITION BY n_regionkey) AS group_size,
       dense_rank() OVER (ORDER BY n_regionkey) AS group_id,
       row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS member_no
FROM nation
""")
def agg8_group_rows(t):
    """AGG8: nations grouped by region with group id, size and member number."""
    return aggs.group_rows(t.nation, ["n_regionkey"], ["n_nationkey"])


@job("agg9_distinct_options", """
SELECT lower(p_type) AS option_key, arg_min(p_type, p_partkey) AS option FROM part GROUP BY 1 ORDER BY 1
""")
def agg9_distinct_options(t):
    """AGG9: distinct part types for a filter drop-down (case-insensitive, first spelling)."""
    return aggs.distinct_options(t.part, "p_type", "p_partkey")


@job("agg10_hit_counts", """
SELECT lang, count(*) AS hits FROM documents WHERE contains(lower(text), 'the') GROUP BY ROLLUP (lang)
""")
def agg10_hit_counts(t):
    """AGG10: documents matching 'the' per language and in total (whole texts searched)."""
    return aggs.hit_counts(search(t.documents.select("doc_id", "lang", "text"), "the", ["text"]), "lang")


@job("agg11_footer", """
SELECT count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price,
       max(l_discount) AS max_discount
FROM lineitem WHERE l_returnflag = 'R'
""")
def agg11_footer(t):
    """AGG11: footer aggregates over the filtered rows."""
    li = t.lineitem.where(F.col("l_returnflag") == "R")
    return aggs.footer(li, {"n": F.count(F.lit(1)), "sum_qty": F.round(F.sum("l_quantity"), 2),
                            "avg_price": F.round(F.avg("l_extendedprice"), 2),
                            "max_discount": F.max("l_discount")})


@job("agg12_box_stats", """
SELECT l_returnflag, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,
       max(l_extendedprice) AS max
FROM lineitem GROUP BY l_returnflag
""")
def agg12_box_stats(t):
    """AGG12: exact five-number summary of price per return flag."""
    r = aggs.box_stats(t.lineitem, "l_returnflag", "l_extendedprice")
    return r.select("l_returnflag", "min", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "max")


@job("agg13_ohlc", """
SELECT event_type, time_bucket(INTERVAL 30 MINUTES, ts) AS bucket_start,
       arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, event_id)) AS close, count(*) AS n
FROM events GROUP BY 1, 2
""")
def agg13_ohlc(t):
    """AGG13: 30-minute open/high/low/close bars of event value per type."""
    return aggs.ohlc(t.events, "ts", "value", "30 minutes", "event_id", by=["event_type"])


@job("agg14_matrix", """
SELECT event_type,
""" + ",\n".join(f"  count(*) FILTER (WHERE dayofweek(ts) + 1 = {d}) AS \"{d}\"" for d in range(1, 8)) + """
FROM events GROUP BY event_type
""")
def agg14_matrix(t):
    """AGG14: event type x weekday count matrix (columns 1..7 = Sunday..Saturday)."""
    e = t.events.select("event_type", F.dayofweek("ts").alias("weekday"))
    m = aggs.matrix(e, "event_type", "weekday", list(range(1, 8)), F.count(F.lit(1)))
    return m.select("event_type", *[F.coalesce(F.col(str(d)), F.lit(0)).alias(str(d)) for d in range(1, 8)])


@job("agg15_count_requests", """
WITH r AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT c.c_custkey, c.c_name, CAST(c.c_nationkey % 3 AS BIGINT) + coalesce(r.n, 0) AS contacts_requests
FROM customer c LEFT JOIN r ON r.user_id = c.c_custkey
""")
def agg15_count_requests(t):
    """AGG15: contact-request counter per customer incremented by this batch's requests."""
    base = t.customer.select("c_custkey", "c_name", (F.col("c_nationkey") % 3).cast("bigint").alias("contacts_requests"))
    req = t.events.where(F.col("event_type") == "signup").select(F.col("user_id").alias("c_custkey"))
    return aggs.count_requests(base, req, "c_custkey", "contacts_requests")
