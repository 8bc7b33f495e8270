"""Registered jobs: JOIN1-JOIN10."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from haulframe.operators import joins
from haulframe.operators.setops import exclude
from haulframe.plans import standins
from haulframe.plans.registry import job

# Stand-ins (FIXTURES section 3): customers are users (e-mail = lower(c_name)),
# suppliers are clients, orders are report submissions.
_USERS_SQL = "SELECT c_custkey AS user_id, lower(c_name) AS email FROM customer"
_CLIENTS_SQL = """SELECT s_suppkey AS client_id,
       CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 END AS user_id,
       'customer#' || lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0') AS email FROM supplier"""
_SUBMISSIONS_SQL = """SELECT o_orderkey AS arrival,
       'CUSTOMER#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS email_nm FROM orders"""


def _users(t):
    return t.customer.select(F.col("c_custkey").alias("user_id"), F.lower("c_name").alias("email"))


def _clients(t):
    s = t.supplier
    return s.select(F.col("s_suppkey").alias("client_id"),
                    F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") * 3).alias("user_id"),
                    F.concat(F.lit("customer#"), F.lpad((F.col("s_suppkey") * 7).cast("string"), 9, "0")).alias("email"))


def _submissions(t):
    return t.orders.select(F.col("o_orderkey").alias("arrival"),
                           F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
                           .alias("email_nm"))


RESOLVE_SQL = f"""
WITH s AS ({_SUBMISSIONS_SQL}),
u AS (SELECT email, min(user_id) AS user_id FROM ({_USERS_SQL}) GROUP BY email),
c AS ({_CLIENTS_SQL}),
cu AS (SELECT user_id, min(client_id) AS cu FROM c WHERE user_id IS NOT NULL GROUP BY user_id),
ce AS (SELECT email, min(client_id) AS ce FROM c GROUP BY email),
j AS (SELECT s.arrival, s.email_nm, lower(s.email_nm) AS email, u.user_id, cu.cu, ce.ce
      FROM s LEFT JOIN u ON u.email = lower(s.email_nm)
      LEFT JOIN cu ON cu.user_id = u.user_id
      LEFT JOIN ce ON ce.email = lower(s.email_nm))
SELECT arrival, email_nm, email, user_id,
       CASE WHEN user_id IS NOT NULL AND cu IS NOT NULL THEN cu ELSE ce END AS client_id,
       CASE WHEN user_id IS NOT NULL AND cu IS NOT NULL THEN 'client_of_user'
            WHEN user_id IS NOT NULL THEN 'update_or_create'
            WHEN ce IS NOT NULL THEN 'client_by_email' ELSE 'create' END AS branch
FROM j
"""


@job("join1_resolve_client", RESOLVE_SQL)
def join1_resolve_client(t):
    """JOIN1: resolve each report submission to a client."""
    return joins.resolve_client(_submissions(t), _users(t), _clients(t))


@job("join2_semi", """
SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
""")
def join2_semi(t):
    """JOIN2: customers that are members of region 1's nations."""
    members = t.nation.where(F.col("n_regionkey") == 1).select(F.col("n_nationkey").alias("c_nationkey"))
    return joins.semi(t.customer, members, ["c_nationkey"])


@job("join3_exclude", "SELECT * FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)")
def join3_exclude(t):
    """JOIN3: parts not already chosen by a large line item."""
    chosen = t.lineitem.where(F.col("l_quantity") >= 48).select(F.col("l_partkey").alias("p_partkey"))
    return exclude(t.part, chosen, ["p_partkey"])


_GRANT_USERS_SQL = """SELECT c_custkey AS user_id,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'member' END AS user_type FROM customer"""
_PERMS_SQL = """SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'manage_' ELSE 'view_' END
       || lower(replace(r_name, ' ', '_')) AS codename FROM region"""


def _grant_users(t):
    return t.customer.select(F.col("c_custkey").alias("user_id"),
                             F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("member").alias("user_type"))


def _perms(t):
    return t.region.select(F.concat(F.when(F.col("r_regionkey") % 2 == 0, "manage_").otherwise("view_"),
                                    F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))).alias("codename"))


@job("join4_expand_grants", f"""
WITH u AS ({_GRANT_USERS_SQL}), p AS ({_PERMS_SQL})
SELECT u.user_id, 'permission' AS kind, p.codename AS "grant"
FROM u JOIN (SELECT DISTINCT codename FROM p WHERE starts_with(codename, 'manage')) p ON u.user_type = 'admin'
UNION ALL SELECT user_id, 'permission', 'access_' || user_type || '_pages' FROM u
UNION ALL SELECT user_id, 'group', upper(substr(user_type, 1, 1)) || substr(user_type, 2) || 's' FROM u
""")
def join4_expand_grants(t):
    """JOIN4: sign-up grants (manage* permissions for admins, access page and group for all)."""
    return joins.expand_grants(_grant_users(t), _perms(t))


@job("join5_audience", """
SELECT lower(c.c_name) AS email, r.r_regionkey AS newsletter_id
FROM customer c JOIN region r ON r.r_regionkey % 2 = 0
WHERE c.c_acctbal >= 0
""")
def join5_audience(t):
    """JOIN5: undispatched newsletters (regions) x subscribers not removed (customers)."""
    news = t.region.select(F.col("r_regionkey").alias("newsletter_id"),
                           (F.col("r_regionkey") % 2 == 1).alias("dispatched"))
    subs = t.customer.select(F.lower("c_name").alias("email"), (F.col("c_acctbal") < 0).alias("removed"))
    return joins.audience(news, subs)


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@job("join6_align_series", """
SELECT x, """ + ", ".join(
    f"round(sum(y) FILTER (WHERE series = '{s}'), 2) AS {s}" for s in _EVENT_TYPES) + """
FROM (SELECT event_type AS series, CAST(ts AS DATE) AS x, sum(value) AS y FROM events GROUP BY 1, 2) GROUP BY x
""")
def join6_align_series(t):
    """JOIN6: align daily series of all event types on the union of days."""
    a = joins.align_series(standins.chart_series(t), "series", "x", "y")
    return a.select("x", *[F.round(s, 2).alias(s) for s in a.columns if s != "x"])


@job("join7_overlaps", """
WITH iv AS (SELECT event_id, user_id, ts AS start_ts,
                   ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS end_ts FROM events)
SELECT i.event_id, i.user_id, i.start_ts, i.end_ts,
       EXISTS (SELECT 1 FROM iv j WHERE j.user_id = i.user_id AND j.event_id <> i.event_id
                 AND j.start_ts <= i.end_ts AND i.start_ts <= j.end_ts) AS overlaps
FROM iv i
""")
def join7_overlaps(t):
    """JOIN7: flag events whose [ts, ts + value minutes] overlaps another event of the same user."""
    iv = standins.intervals(t)
    return joins.overlaps(iv, "user_id", "start_ts", "end_ts", "event_id", F.to_date("start_ts"))


_TREE_SQL = """
WITH RECURSIVE e AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS pid FROM region
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
),
t (id, pid, level, path) AS (
  SELECT id, pid, 1, id FROM e WHERE pid IS NULL OR pid = '' OR pid = '0'
  UNION ALL SELECT e.id, e.pid, t.level + 1, t.path || '/' || e.id FROM e JOIN t ON e.pid = t.id
),
c AS (SELECT pid AS id, count(*) AS child_count FROM e WHERE pid IS NOT NULL GROUP BY pid)
SELECT t.id, t.pid, t.level, t.path, coalesce(c.child_count, 0) AS child_count,
       row_number() OVER (PARTITION BY t.pid ORDER BY t.id) AS sibling_no
FROM t LEFT JOIN c ON c.id = t.id
"""


@job("join8_tree", _TREE_SQL)
def join8_tree(t):
    """JOIN8: region -> nation -> supplier tree with level, path and child counts."""
    e = (t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
                         F.lit(None).cast("string").alias("pid"))
         .unionByName(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
                                      F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("pid")))
         .unionByName(t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
                                        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("pid"))))
    return joins.tree(t.spark, e)


@job("join9_expand_recurrence", """
WITH rules AS (
  SELECT event_id AS rule_id,
         [CAST(dayofweek(ts) AS INTEGER), CAST((dayofweek(ts) + 3) % 7 AS INTEGER)] AS days_of_week,
         CAST(hour(ts) * 3600 + minute(ts) * 60 AS INTEGER) AS start_time,
         CAST(hour(ts) * 3600 + minute(ts) * 60 + CAST(round(value) AS INTEGER) * 60 AS INTEGER) AS end_time,
         CAST(ts AS DATE) AS start_recur, CAST(ts AS DATE) + INTERVAL 14 DAY AS end_recur
  FROM events WHERE event_type = 'signup'),
d AS (SELECT rule_id, days_of_week, start_time, end_time,
             CAST(unnest(generate_series(greatest(start_recur, DATE '2024-01-10'),
                                         least(CAST(end_recur AS DATE), DATE '2024-01-24') - INTERVAL 1 DAY,
                                         INTERVAL 1 DAY)) AS DATE) AS day
      FROM rules WHERE greatest(start_recur, DATE '2024-01-10') < least(CAST(end_recur AS DATE), DATE '2024-01-24'))
SELECT rule_id, day, CAST(day AS TIMESTAMP) + to_seconds(start_time) AS instance_start,
       CAST(day AS TIMESTAMP) + to_seconds(end_time) AS instance_end
FROM d WHERE list_contains(days_of_week, CAST(dayofweek(day) AS INTEGER))
""")
def join9_expand_recurrence(t):
    """JOIN9: weekly recurrence rules (one per signup event) expanded into 2024-01-10..23."""
    e = t.events.where(F.col("event_type") == "signup")
    dow = F.dayofweek("ts") - 1
    secs = F.hour("ts") * 3600 + F.minute("ts") * 60
    rules = e.select(F.col("event_id").alias("rule_id"),
                     F.array(dow, (dow + 3) % 7).alias("days_of_week"),
                     secs.alias("start_time"),
                     (secs + F.round("value").cast("int") * 60).alias("end_time"),
                     F.to_date("ts").alias("start_recur"), F.date_add(F.to_date("ts"), 14).alias("end_recur"))
    return joins.expand_recurrence(rules, dt.date(2024, 1, 10), dt.date(2024, 1, 24))


@job("join9_every_day", """
SELECT event_id AS rule_id, CAST(d.day AS DATE) AS day, CAST(d.day AS TIMESTAMP) AS instance_start,
       CAST(d.day AS TIMESTAMP) + to_seconds(CAST(round(value) AS INTEGER) * 60) AS instance_end
FROM events, (SELECT unnest(generate_series(DATE '2024-01-10', DATE '2024-01-16', INTERVAL 1 DAY)) AS day) d
WHERE event_type = 'signup' AND CAST(ts AS DATE) <= CAST(d.day AS DATE)
""")
def join9_every_day(t):
    """JOIN9: rules without days of the week, start time and end bound: one instance every day from midnight."""
    e = t.events.where(F.col("event_type") == "signup")
    rules = e.select(F.col("event_id").alias("rule_id"), F.lit(None).cast("array<int>").alias("days_of_week"),
                     F.lit(None).cast("int").alias("start_time"), (F.round("value").cast("int") * 60).alias("end_time"),
                     F.to_date("ts").alias("start_recur"), F.lit(None).cast("date").alias("end_recur"))
    return joins.expand_recurrence(rules, dt.date(2024, 1, 10), dt.date(2024, 1, 17))


@job("join10_attach_values", """
WITH v AS (SELECT 'N' || CAST(c.c_nationkey AS VARCHAR) AS code, round(sum(o.o_totalprice), 2) AS revenue
           FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1)
SELECT r.code, r.n_name, v.revenue
FROM (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS code, n_name FROM nation WHERE n_regionkey <> 4) r
JOIN v USING (code)
""")
def join10_attach_values(t):
    """JOIN10: revenue per customer nation attached to the nations on the map (region 4 not shown)."""
    v = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
         .groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("code"))
         .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")))
    regions = t.nation.where(F.col("n_regionkey") != 4).select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), "n_name")
    return joins.attach_values(regions, v, "code")
