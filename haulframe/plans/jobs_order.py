"""Registered jobs: ORD1-ORD4, PAG1-PAG3, TOP1, WIN1, WIN2, WIN5, WIN6."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulframe.operators import ordering as od
from haulframe.plans.registry import job


@job("ord1_sort_smart", """
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, k, row_number() OVER (
  ORDER BY coalesce(k, '') = '' DESC, TRY_CAST(trim(coalesce(k, '')) AS DOUBLE) IS NULL ASC,
           TRY_CAST(trim(coalesce(k, '')) AS DOUBLE) ASC, coalesce(k, '') ASC, event_id ASC) AS position
FROM e
""")
def ord1_sort_smart(t):
    """ORD1: type-aware sort of a text column holding numbers (numeric order, not text order)."""
    e = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return od.sort_smart(e, "k", ["event_id"])


@job("ord1_sort_smart_desc", """
SELECT c_custkey, c_name, row_number() OVER (
  ORDER BY coalesce(c_name, '') = '' ASC, TRY_CAST(trim(coalesce(c_name, '')) AS DOUBLE) IS NULL DESC,
           TRY_CAST(trim(coalesce(c_name, '')) AS DOUBLE) DESC, coalesce(c_name, '') DESC, c_custkey ASC) AS position
FROM customer
""")
def ord1_sort_smart_desc(t):
    """ORD1: descending text sort with empty cells last."""
    return od.sort_smart(t.customer.select("c_custkey", "c_name"), "c_name", ["c_custkey"], descending=True,
                         empty_last=True)


@job("ord2_sort_multi", """
SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (
  ORDER BY lower(o_orderpriority) ASC, o_totalprice DESC, o_orderkey ASC) AS position
FROM orders
""")
def ord2_sort_multi(t):
    """ORD2: multi-column sort with per-column direction and case folding."""
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return od.sort_multi(o, [("o_orderpriority", "asc"), ("o_totalprice", "desc")], ["o_orderkey"], fold_case=True)


@job("ord2_sort_numeric_text", """
WITH d AS (SELECT doc_id, CAST(n_chars AS VARCHAR) AS size, source FROM documents)
SELECT doc_id, size, source, row_number() OVER (
  ORDER BY CAST(size AS BIGINT) DESC, lower(source) ASC, doc_id ASC) AS position FROM d
""")
def ord2_sort_numeric_text(t):
    """ORD2: a text column that holds numbers sorts by value."""
    d = t.documents.select("doc_id", F.col("n_chars").cast("string").alias("size"), "source")
    return od.sort_multi(d, [("size", "desc"), ("source", "asc")], ["doc_id"], fold_case=True)


@job("ord3_order_groups", """
SELECT doc_id, lang, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 END, doc_id) AS position
FROM documents WHERE lang IN ('fr', 'en')
""")
def ord3_order_groups(t):
    """ORD3: explicit group order (fr, en), other groups dropped, members by id."""
    return od.order_groups(t.documents.select("doc_id", "lang"), "lang", ["fr", "en"], ["doc_id"])


@job("ord3_order_groups_desc", """
SELECT doc_id, lang, row_number() OVER (ORDER BY lang DESC, doc_id) AS position FROM documents
""")
def ord3_order_groups_desc(t):
    """ORD3: groups in descending order, members by id."""
    return od.order_groups(t.documents.select("doc_id", "lang"), "lang", "desc", ["doc_id"])


@job("ord4_sort_natural", """
SELECT p_partkey, p_brand, row_number() OVER (ORDER BY
  regexp_extract(p_brand, '^[^0-9]*'), CAST(regexp_extract(p_brand, '[0-9]+') AS HUGEINT), p_partkey) AS position
FROM part
""")
def ord4_sort_natural(t):
    """ORD4: natural order of brand codes (Brand#2 before Brand#17)."""
    return od.sort_natural(t.part.select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])


@job("pag1_page", """
WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT count(*) AS total FROM f),
p AS (SELECT least(greatest(7, 1), greatest(1, CAST(ceil(total / 25.0) AS BIGINT))) AS page_number, total FROM n)
SELECT f.* EXCLUDE (rn), p.total, (SELECT count(*) FROM orders) AS total_unfiltered,
       CAST(CASE WHEN p.total = 0 THEN 0 ELSE (p.page_number - 1) * 25 + 1 END AS INTEGER) AS from_row,
       CAST(least(p.page_number * 25, p.total) AS INTEGER) AS to_row, p.page_number
FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM f) f, p
WHERE f.rn > (p.page_number - 1) * 25 AND f.rn <= p.page_number * 25
""")
def pag1_page(t):
    """PAG1: page 7 of 25 rows of finished orders by date."""
    o = t.orders
    rows = od.page(o, ["o_orderdate", "o_orderkey"], 7, 25, where=F.col("o_orderstatus") == "F")
    return rows


@job("pag2_table_request", """
WITH f AS (SELECT * FROM customer
           WHERE regexp_matches(c_name || ' ' || c_mktsegment, 'building', 'i'))
SELECT f.*, 3 AS draw, (SELECT count(*) FROM customer) AS records_total, (SELECT count(*) FROM f) AS records_filtered
FROM f ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20
""")
def pag2_table_request(t):
    """PAG2: server-side table request (search, order, start/length, totals)."""
    req = {"draw": 3, "start": 20, "length": 10,
           "search": {"value": "building", "columns": ["c_name", "c_mktsegment"]},
           "order": [("c_acctbal", "desc")]}
    return od.table_request(t.customer, req, ["c_custkey"])


@job("pag1_deep_page", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate,
                  row_number() OVER (ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem),
n AS (SELECT count(*) AS total, CAST(floor(count(*) / 80) AS BIGINT) AS page_number FROM r)
SELECT r.* EXCLUDE (rn), total, total AS total_unfiltered, CAST((page_number - 1) * 40 + 1 AS INTEGER) AS from_row,
       CAST(page_number * 40 AS INTEGER) AS to_row, page_number
FROM r, n WHERE rn > (page_number - 1) * 40 AND rn <= page_number * 40
""")
def pag1_deep_page(t):
    """PAG1: the page in the middle of all line items by ship date, found by a rank index of the keys."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return od.page(rows, [("l_shipdate", "desc"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], rows.count() // 80, 40)


@job("pag3_page_windows", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position,
       CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1020) AS BIGINT) AS window_id,
       CAST(floor(((row_number() OVER (ORDER BY o_orderkey) - 1) % 1020) / 30) + 1 AS BIGINT) AS page_in_window
FROM orders
""")
def pag3_page_windows(t):
    """PAG3: prefetch windows of 1000 rows rounded up to 30-row pages (1020)."""
    return od.page_windows(t.orders.select("o_orderkey"), [F.col("o_orderkey")], 1000, 30)


@job("top1_top_k", """
SELECT * FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate LIMIT 10
""")
def top1_top_k(t):
    """TOP1: first 10 line items by price."""
    order = [F.col("l_extendedprice").desc()] + [F.col(c) for c in
                                                 ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                  "l_quantity", "l_shipdate")]
    return od.top_k(t.lineitem, order, 10)


@job("win1_run_groups", """
WITH e AS (
  SELECT event_id, user_id, event_type, value >= 250 AS big,
         coalesce(CAST(event_type AS VARCHAR), '') AS l1,
         coalesce(CAST(event_type AS VARCHAR), '') || chr(1) || coalesce(CAST(value >= 250 AS VARCHAR), '') AS l2,
         ts FROM events),
c AS (
  SELECT *, CASE WHEN l1 IS NOT DISTINCT FROM lag(l1) OVER w THEN 0 ELSE 1 END AS c1,
            CASE WHEN l2 IS NOT DISTINCT FROM lag(l2) OVER w THEN 0 ELSE 1 END AS c2
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type, big,
       sum(c1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS group_1,
       sum(c2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS group_2
FROM c
""")
def win1_run_groups(t):
    """WIN1: contiguous runs of event type (and a nested size flag) per user in time order."""
    e = t.events.select("event_id", "user_id", "event_type", (F.col("value") >= 250).alias("big"), "ts")
    r = od.run_groups(e, ["user_id"], F.to_date("ts"), ["ts", "event_id"], ["event_type", "big"])
    return r.select("event_id", "user_id", "event_type", "big", "group_1", "group_2")


@job("win2_top_per_group", """
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS group_rank
           FROM documents),
f AS (SELECT lang, min(doc_id) AS first_id FROM documents GROUP BY lang)
SELECT doc_id, lang, source, group_rank FROM r JOIN f USING (lang)
WHERE group_rank <= 3 ORDER BY first_id, group_rank LIMIT 10
""")
def win2_top_per_group(t):
    """WIN2: 3 documents per language in arrival order, 10 overall."""
    d = t.documents.select("doc_id", "lang", "source")
    return od.top_per_group(d, "lang", ["doc_id"], 3, 10)


@job("win5_min_step", """
WITH e AS (SELECT user_id, epoch_us(ts) AS x, event_id FROM events),
s AS (SELECT user_id, x - lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) AS step FROM e)
SELECT user_id, coalesce(CAST(min(CASE WHEN step > 0 THEN step END) AS DOUBLE), 0.5) AS min_step
FROM s GROUP BY user_id
""")
def win5_min_step(t):
    """WIN5: smallest positive gap (microseconds) between a user's events."""
    e = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("x"), "event_id", "ts")
    return od.min_step(e.drop("ts"), "user_id", "x", F.floor(F.col("x") / 86_400_000_000), ["event_id"])


@job("win6_with_position", """
SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) AS position FROM events
""")
def win6_with_position(t):
    """WIN6: stable position by event type (equal keys keep arrival order)."""
    return od.with_position(t.events.select("event_id", "event_type"), ["event_type"], "event_id")
