"""Registered jobs: SET1-SET4."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulframe.operators import setops
from haulframe.plans.registry import job


@job("set1_append", """
SELECT *, 0 AS _src FROM nation UNION ALL SELECT n_nationkey, n_name, NULL, 1 FROM nation WHERE n_regionkey = 1
""")
def set1_append(t):
    """SET1: append rows (duplicates kept, missing columns null)."""
    more = t.nation.where(F.col("n_regionkey") == 1).select("n_nationkey", "n_name")
    return setops.append(t.nation, more)


@job("set2_tagged_union", """
SELECT c_custkey AS id, c_name AS display, 'customers' AS "group" FROM customer
UNION ALL SELECT s_suppkey, s_name, 'suppliers' FROM supplier
""")
def set2_tagged_union(t):
    """SET2: union of named sources tagged with the source name."""
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("display"))
    return setops.tagged_union({"customers": c, "suppliers": s}, "display")


@job("set3_distinct_tags", """
WITH e AS (SELECT user_id, event_id, trim(event_type) AS event_type FROM events WHERE trim(event_type) <> ''),
f AS (SELECT user_id, lower(event_type) AS k, arg_min(event_type, event_id) AS event_type,
                  min(event_id) AS first_arrival FROM e GROUP BY 1, 2)
SELECT user_id, event_type, first_arrival,
       row_number() OVER (PARTITION BY user_id ORDER BY first_arrival) AS tag_rank
FROM f QUALIFY tag_rank <= 3
""")
def set3_distinct_tags(t):
    """SET3: first three distinct event types per user (case-insensitive, arrival order)."""
    return setops.distinct_tags(t.events, "user_id", "event_type", "event_id", case_sensitive=False, limit=3)


@job("set4_subtract_keep", """
SELECT * FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 25)
""")
def set4_subtract_keep(t):
    """SET4: line items whose part is not a large part (duplicates kept)."""
    big = t.part.where(F.col("p_size") > 25).select(F.col("p_partkey").alias("l_partkey"))
    return setops.subtract_keep(t.lineitem, big, ["l_partkey"])
