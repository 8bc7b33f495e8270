"""Registered jobs: UPS1-UPS6."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulframe.operators import upserts as ups
from haulframe.plans import standins
from haulframe.plans.jobs_joins import (
    _SUBMISSIONS_SQL, _USERS_SQL, _clients, _perms, _PERMS_SQL, _submissions, _users,
)
from haulframe.plans.registry import job
from haulframe.plans.standins import SUBSCRIPTION_REQUESTS_SQL

# Stored subscriptions: customers of even nations, company 'none' for the BUILDING segment.
_SUBS_STATE_SQL = """SELECT 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'none' ELSE lower(c_mktsegment) END AS company,
       'lo' AS area, c_acctbal < 0 AS removed
FROM customer WHERE c_nationkey % 2 = 0"""


def _subs_state(t):
    c = t.customer.where(F.col("c_nationkey") % 2 == 0)
    return c.select(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "none").otherwise(F.lower("c_mktsegment"))
                    .alias("company"), F.lit("lo").alias("area"), (F.col("c_acctbal") < 0).alias("removed"))


_UPS1_BASE = f"""
WITH st AS ({_SUBS_STATE_SQL}),
rq AS ({SUBSCRIPTION_REQUESTS_SQL}),
r AS (SELECT arrival, lower(em_nl) AS email, lower(coalesce(nullif(cp_name, ''), 'none')) AS company,
             CASE WHEN tp_area = 1 THEN 'lo' WHEN tp_area = 2 THEN 'ki' ELSE '' END AS area FROM rq),
f AS (SELECT email, min(arrival) AS first_arrival, arg_min(area, arrival) AS first_area,
             min(arrival) FILTER (WHERE company <> 'none') AS f_arrival,
             arg_min(company, arrival) FILTER (WHERE company <> 'none') AS f_company,
             arg_min(area, arrival) FILTER (WHERE company <> 'none') AS f_area
      FROM r GROUP BY email)
"""


@job("ups1_subscription_outcomes", _UPS1_BASE + f"""
, j AS (SELECT r.*, f.first_arrival, f.f_arrival, f.f_company, lower(coalesce(st.company, 'none')) AS c0,
               st.email IS NOT NULL AS stored
        FROM r JOIN f USING (email) LEFT JOIN st USING (email)),
b AS (SELECT *, CASE WHEN stored AND c0 <> 'none' THEN c0
                     WHEN f_arrival IS NOT NULL AND f_arrival < arrival THEN f_company ELSE 'none' END AS bef,
             (NOT stored) AND arrival = first_arrival AS no_row FROM j),
o AS (SELECT arrival, email, company,
             CASE WHEN no_row THEN 'registered'
                  WHEN bef = 'none' THEN CASE WHEN company = 'none' THEN 'already_registered' ELSE 'registered' END
                  WHEN company = bef THEN 'already_registered' ELSE 'different_company' END AS outcome FROM b)
SELECT *, CASE outcome WHEN 'registered' THEN '{ups.MSG_REGISTERED}' WHEN 'already_registered' THEN '{ups.MSG_ALREADY}'
               ELSE '{ups.MSG_OTHER_COMPANY}' END AS message FROM o
""")
def ups1_subscription_outcomes(t):
    """UPS1: one outcome message per newsletter sign-up request."""
    return ups.upsert_subscriptions(_subs_state(t), standins.subscription_requests(t))[0]


@job("ups1_subscription_state", _UPS1_BASE + """
, n AS (SELECT coalesce(st.email, f.email) AS email, st.company AS company0, st.area AS area0, st.removed AS removed0,
               f.first_area, f.f_company, f.f_area, st.email IS NOT NULL AS stored, f.email IS NOT NULL AS touched,
               st.email IS NOT NULL AND lower(coalesce(st.company, 'none')) <> 'none' AS keep
        FROM st FULL OUTER JOIN f ON st.email = f.email)
SELECT email,
       CASE WHEN keep THEN company0 WHEN f_company IS NOT NULL THEN f_company
            WHEN stored THEN company0 ELSE 'none' END AS company,
       CASE WHEN keep THEN area0 WHEN f_company IS NOT NULL THEN f_area
            WHEN stored THEN area0 ELSE first_area END AS area,
       coalesce(removed0, false) AS removed,
       CASE WHEN NOT stored THEN 'inserted' WHEN touched AND NOT keep AND f_company IS NOT NULL THEN 'updated'
            ELSE 'unchanged' END AS action
FROM n
""")
def ups1_subscription_state(t):
    """UPS1: stored subscriptions after the batch of sign-ups."""
    return ups.upsert_subscriptions(_subs_state(t), standins.subscription_requests(t))[1]


_CLIENT_STATE_SQL = """SELECT s_suppkey AS client_id,
       CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 END AS user_id, 'co' || CAST(s_suppkey AS VARCHAR) AS company,
       'customer#' || lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0') AS email, s_name AS contact_name FROM supplier"""


def _client_state(t):
    c = _clients(t)
    s = t.supplier.select(F.col("s_suppkey").alias("client_id"),
                          F.concat(F.lit("co"), F.col("s_suppkey").cast("string")).alias("company"),
                          F.col("s_name").alias("contact_name"))
    return c.join(s, "client_id").select("client_id", "user_id", "company", "email", "contact_name")


def _client_submissions(t):
    s = _submissions(t)
    o = t.orders.select(F.col("o_orderkey").alias("arrival"), F.col("o_orderpriority").alias("cp_nm"),
                        F.concat(F.lit("contact "), F.col("o_custkey").cast("string")).alias("client_nm"))
    return s.join(o, "arrival")


@job("ups2_upsert_clients", f"""
WITH st AS ({_CLIENT_STATE_SQL}),
s AS (SELECT x.arrival, x.email_nm, o.o_orderpriority AS cp_nm, 'contact ' || CAST(o.o_custkey AS VARCHAR) AS client_nm
      FROM ({_SUBMISSIONS_SQL}) x JOIN orders o ON o.o_orderkey = x.arrival),
u AS (SELECT email, min(user_id) AS user_id FROM ({_USERS_SQL}) GROUP BY email),
cu AS (SELECT user_id, min(client_id) AS cu FROM st WHERE user_id IS NOT NULL GROUP BY user_id),
ce AS (SELECT email, min(client_id) AS ce FROM st GROUP BY email),
j AS (SELECT s.*, lower(s.email_nm) AS email, u.user_id, cu.cu, ce.ce FROM s
      LEFT JOIN u ON u.email = lower(s.email_nm) LEFT JOIN cu ON cu.user_id = u.user_id
      LEFT JOIN ce ON ce.email = lower(s.email_nm)),
rs AS (SELECT *, CASE WHEN user_id IS NOT NULL AND cu IS NOT NULL THEN cu ELSE ce END AS client_id,
              CASE WHEN user_id IS NOT NULL AND cu IS NOT NULL THEN 'client_of_user'
                   WHEN user_id IS NOT NULL THEN 'update_or_create'
                   WHEN ce IS NOT NULL THEN 'client_by_email' ELSE 'create' END AS branch FROM j),
fst AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY email ORDER BY arrival) = 1),
act AS (SELECT * FROM fst WHERE branch IN ('update_or_create', 'create')),
upd AS (SELECT client_id AS cid, user_id AS uid, cp_nm, client_nm, branch FROM act WHERE client_id IS NOT NULL),
ins AS (SELECT * FROM act WHERE client_id IS NULL)
SELECT st.client_id,
       CASE WHEN upd.cid IS NOT NULL AND upd.branch = 'update_or_create' THEN upd.uid ELSE st.user_id END AS user_id,
       CASE WHEN upd.cid IS NOT NULL THEN upd.cp_nm ELSE st.company END AS company, st.email,
       CASE WHEN upd.cid IS NOT NULL THEN upd.client_nm ELSE st.contact_name END AS contact_name,
       CASE WHEN upd.cid IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS action
FROM st LEFT JOIN upd ON upd.cid = st.client_id
UNION ALL
SELECT CAST((SELECT max(client_id) FROM st) + row_number() OVER (ORDER BY arrival) AS BIGINT),
       CAST(CASE WHEN branch = 'update_or_create' THEN user_id END AS BIGINT), cp_nm, email, client_nm, 'inserted'
FROM ins
""")
def ups2_upsert_clients(t):
    """UPS2: clients after a batch of report submissions (updated, inserted, unchanged)."""
    return ups.upsert_clients(_client_state(t), _client_submissions(t), _users(t))


_CALL_CLIENTS_SQL = """SELECT c_custkey AS client_id, lower(c_name) AS email,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS company,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'c' || CAST(c_custkey AS VARCHAR) END AS contact_name,
       'tel-' || CAST(c_custkey AS VARCHAR) AS phone FROM customer"""
_CALL_REQUESTS_SQL = """SELECT event_id AS arrival, 'CUSTOMER#' || lpad(CAST(user_id * 5 AS VARCHAR), 9, '0') AS em_nm,
       CASE WHEN value > 250 THEN 'co' || CAST(event_id AS VARCHAR) ELSE '' END AS cp_nm,
       CASE WHEN value < 100 THEN 'n' || CAST(event_id AS VARCHAR) END AS client_nm,
       'p' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS phone_nb
FROM events WHERE event_type = 'signup'"""


def _call_clients(t):
    c = t.customer
    return c.select(F.col("c_custkey").alias("client_id"), F.lower("c_name").alias("email"),
                    F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("company"),
                    F.when(F.col("c_custkey") % 2 == 0, F.lit(None)).otherwise(
                        F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("contact_name"),
                    F.concat(F.lit("tel-"), F.col("c_custkey").cast("string")).alias("phone"))


def _call_requests(t):
    e = t.events.where(F.col("event_type") == "signup")
    return e.select(F.col("event_id").alias("arrival"),
                    F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("user_id") * 5).cast("string"), 9, "0")).alias("em_nm"),
                    F.when(F.col("value") > 250, F.concat(F.lit("co"), F.col("event_id").cast("string")))
                    .otherwise("").alias("cp_nm"),
                    F.when(F.col("value") < 100, F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("client_nm"),
                    F.concat(F.lit("p"), F.floor("value").cast("bigint").cast("string")).alias("phone_nb"))


_UPS3_BASE = f"""
WITH cl AS ({_CALL_CLIENTS_SQL}), rq AS ({_CALL_REQUESTS_SQL}),
fc AS (SELECT email, min(client_id) AS client_id FROM cl GROUP BY email),
r AS (SELECT rq.*, fc.client_id FROM rq JOIN fc ON fc.email = lower(rq.em_nm))
"""


@job("ups3_book_calls", _UPS3_BASE + "SELECT arrival, client_id, false AS called FROM r")
def ups3_book_calls(t):
    """UPS3: one call row per request of a known client."""
    return ups.book_calls(_call_clients(t), _call_requests(t))[1]


@job("ups3_call_clients", _UPS3_BASE + """
, f AS (SELECT client_id,
               arg_min(client_nm, arrival) FILTER (WHERE coalesce(client_nm, '') <> '') AS c_contact,
               arg_min(cp_nm, arrival) FILTER (WHERE coalesce(cp_nm, '') <> '') AS c_company,
               arg_max(phone_nb, arrival) AS c_phone, true AS req
        FROM r GROUP BY client_id)
SELECT cl.client_id, cl.email,
       CASE WHEN f.req AND coalesce(cl.company, '') = '' THEN f.c_company ELSE cl.company END AS company,
       CASE WHEN f.req AND coalesce(cl.contact_name, '') = '' THEN f.c_contact ELSE cl.contact_name END AS contact_name,
       CASE WHEN f.req THEN f.c_phone ELSE cl.phone END AS phone,
       CASE WHEN f.req THEN 'updated' ELSE 'unchanged' END AS action
FROM cl LEFT JOIN f USING (client_id)
""")
def ups3_call_clients(t):
    """UPS3: clients after the call requests (missing fields filled, last phone kept)."""
    return ups.book_calls(_call_clients(t), _call_requests(t))[0]


_UPDATES_SQL = """SELECT o_custkey AS c_custkey, o_orderkey AS arrival,
       ((CAST(round(o_totalprice * 100) AS BIGINT) + 50) // 100) / 100.0 AS b,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS s FROM orders"""


@job("ups4_update_by_id", f"""
WITH u AS ({_UPDATES_SQL}),
lb AS (SELECT c_custkey, b FROM u WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY arrival DESC) = 1),
ls AS (SELECT c_custkey, s FROM u WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY arrival DESC) = 1)
SELECT c.c_custkey, c.c_name, c.c_nationkey, coalesce(lb.b, c.c_acctbal) AS c_acctbal, coalesce(ls.s, c.c_mktsegment) AS c_mktsegment,
       CASE WHEN c.c_custkey IN (SELECT c_custkey FROM u) THEN 'updated' ELSE 'unchanged' END AS action
FROM customer c LEFT JOIN lb USING (c_custkey) LEFT JOIN ls USING (c_custkey)
""")
def ups4_update_by_id(t):
    """UPS4: merge the order-derived updates, in order of arrival, into each customer row."""
    return ups.update_by_id(t.customer, _order_updates(t), "c_custkey", "arrival")


@job("ups4_replace_by_id", f"""
WITH u AS ({_UPDATES_SQL}),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY arrival DESC) = 1)
SELECT c.c_custkey, CASE WHEN l.c_custkey IS NULL THEN c.c_name END AS c_name,
       CASE WHEN l.c_custkey IS NULL THEN c.c_nationkey END AS c_nationkey,
       CASE WHEN l.c_custkey IS NULL THEN c.c_acctbal ELSE l.b END AS c_acctbal,
       CASE WHEN l.c_custkey IS NULL THEN c.c_mktsegment ELSE l.s END AS c_mktsegment,
       CASE WHEN l.c_custkey IS NULL THEN 'unchanged' ELSE 'updated' END AS action
FROM customer c LEFT JOIN l USING (c_custkey)
""")
def ups4_replace_by_id(t):
    """UPS4: the last order-derived update replaces the whole customer row."""
    return ups.update_by_id(t.customer, _order_updates(t), "c_custkey", "arrival", replace=True)


def _order_updates(t):
    return t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("arrival"),
                          # price / 100 rounded half up to cents, in integer cents so no binary tie is lost
                          (F.floor((F.round(F.col("o_totalprice") * 100).cast("bigint") + 50) / 100) / 100.0)
                          .alias("c_acctbal"),
                          F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_orderpriority"))
                          .alias("c_mktsegment"))


@job("ups5_remove_rows", """
SELECT * FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')
""")
def ups5_remove_rows(t):
    """UPS5: delete orders whose priority is in the removal list."""
    return ups.remove_rows(t.orders, "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED"])


@job("ups6_signup", f"""
WITH u AS (SELECT c_custkey AS user_id, c_name AS username, lower(c_name) AS email,
                  CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'member' END AS user_type FROM customer),
p AS ({_PERMS_SQL})
SELECT 'user' AS table_name, user_id, username || '|' || email || '|staff=false' AS detail, 'batch-1' AS batch_id FROM u
UNION ALL SELECT 'profile', user_id, user_type, 'batch-1' FROM u
UNION ALL SELECT 'user_permission', u.user_id, p.codename, 'batch-1'
  FROM u JOIN (SELECT DISTINCT codename FROM p WHERE starts_with(codename, 'manage')) p ON u.user_type = 'admin'
UNION ALL SELECT 'user_permission', user_id, 'access_' || user_type || '_pages', 'batch-1' FROM u
UNION ALL SELECT 'group_member', user_id, upper(substr(user_type, 1, 1)) || substr(user_type, 2) || 's', 'batch-1' FROM u
""")
def ups6_signup(t):
    """UPS6: sign-up fan-out (user, profile, permissions, group) written as one batch."""
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
                              F.lower("c_name").alias("email"),
                              F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("member").alias("user_type"))
    return ups.signup(users, _perms(t), "batch-1")
