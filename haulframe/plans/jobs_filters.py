"""Registered jobs: FLT1-FLT15, PRJ1-PRJ3, WIN3."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from haulframe.functions.strings import fold_accents
from haulframe.operators import filters as flt
from haulframe.plans.registry import job

# DuckDB spelling of the JS text of a double cell (integral values print bare).
def _js_sql(c: str) -> str:
    return (f"(CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({c} AS VARCHAR) END)")


def _int_prefix_sql(text: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({text}, '^\\s*([-+]?\\d+)', 1), '') AS BIGINT)"


@job("flt1_lookup_first", """
WITH stored AS (SELECT *, lower(c_mktsegment) || '@example.com' AS email FROM customer),
k AS (SELECT DISTINCT lower(upper(c_mktsegment) || '@EXAMPLE.COM') AS lookup_key FROM customer),
f AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY email ORDER BY c_custkey) = 1)
SELECT k.lookup_key, f.c_custkey, f.c_name, f.c_nationkey, f.c_acctbal, f.c_mktsegment, f.email
FROM k LEFT JOIN f ON f.email = k.lookup_key
""")
def flt1_lookup_first(t):
    """FLT1: client e-mail lookup, input lower-cased, lowest id wins."""
    stored = t.customer.withColumn("email", F.concat(F.lower("c_mktsegment"), F.lit("@example.com")))
    keys = t.customer.select(F.concat(F.upper("c_mktsegment"), F.lit("@EXAMPLE.COM")).alias("key"))
    return flt.lookup_first(stored, keys, "email", "c_custkey")


@job("flt2_filter_by", """
SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'
""")
def flt2_filter_by(t):
    """FLT2: column filter map, and."""
    return flt.filter_by(t.orders, {"o_orderstatus": ["F", "P"], "o_orderpriority": "1-URGENT"}, "and")


@job("flt2_filter_by_or", """
SELECT * FROM orders WHERE o_orderstatus IN ('P') OR o_orderpriority = '1-URGENT'
""")
def flt2_filter_by_or(t):
    """FLT2: column filter map, or."""
    return flt.filter_by(t.orders, {"o_orderstatus": ["P"], "o_orderpriority": "1-URGENT"}, "or")


@job("flt3_search", f"""
SELECT * FROM part
WHERE contains(lower(p_name), '19') OR contains(lower(p_brand), '19')
   OR contains(CAST(p_size AS VARCHAR), '19') OR contains({_js_sql('p_retailprice')}, '19')
""")
def flt3_search(t):
    """FLT3: global contains search over string and number cells."""
    return flt.search(t.part, "19", ["p_name", "p_brand", "p_size", "p_retailprice"])


@job("flt4_search_strict", """
SELECT * FROM part WHERE lower(p_type) = 'economy' OR lower(p_brand) = 'economy'
""")
def flt4_search_strict(t):
    """FLT4: strict (whole cell, case-insensitive) search."""
    return flt.search(t.part, "Economy", ["p_type", "p_brand"], mode="strict")


@job("flt5_search_regex", """
SELECT * FROM part WHERE regexp_matches(p_name, '^(red|blue) b', 'i')
""")
def flt5_search_regex(t):
    """FLT5: regex search in /re/flags form."""
    return flt.search(t.part, "/^(red|blue) b/i", ["p_name"], mode="regex")


@job("flt6_search_smart", f"""
SELECT * FROM lineitem
WHERE coalesce({_int_prefix_sql(_js_sql('l_quantity'))} > 45, false)
   OR contains({_js_sql('l_quantity')}, '45<')
""")
def flt6_search_smart(t):
    """FLT6: typed comparison '45<' (reversed: quantity > 45) OR contains."""
    return flt.search(t.lineitem, "45<", ["l_quantity"])


@job("flt7_column_filters", f"""
SELECT * FROM orders
WHERE (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high'))
  AND coalesce({_int_prefix_sql(_js_sql('o_totalprice'))} >= 400000, false)
  AND starts_with(lower(o_orderstatus), 'f')
""")
def flt7_column_filters(t):
    """FLT7: per-column filters AND-ed, '|'-delimited values OR-ed, comparison replaces text test."""
    return flt.column_filters(t.orders, {
        "o_orderpriority": {"value": "URGENT|high"},
        "o_totalprice": {"value": ">=400000"},
        "o_orderstatus": {"value": "F", "mode": "startswith"},
    }, delimiter="|")


@job("flt7_strict_and_regex", """
SELECT * FROM part
WHERE lower(p_type) IN ('small', 'large') AND regexp_matches(lower(p_brand), '^brand#[1-3]')
""")
def flt7_strict_and_regex(t):
    """FLT7: a column that must equal one of two values, another that must match a pattern."""
    return flt.column_filters(t.part, {
        "p_type": {"value": "SMALL|Large", "mode": "strict"},
        "p_brand": {"value": "^brand#[1-3]", "mode": "regex"},
    }, delimiter="|")


@job("flt7_date", """
SELECT event_id, ts, event_type FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05'
""")
def flt7_date(t):
    """FLT7: a date column compared as its day."""
    e = t.events.select("event_id", "ts", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return flt.column_filters(e, {"day": {"value": "2024-01-05", "mode": "date"}}).drop("day")


@job("flt7_array_and_map_cells", """
SELECT doc_id, lang, source FROM documents WHERE contains(lower(source), '7') AND (lower(lang) = 'en' OR lower(source) = 'en')
""")
def flt7_array_and_map_cells(t):
    """FLT7: any element of an array cell, any value of a map cell."""
    d = t.documents.select("doc_id", "lang", "source", F.array("source").alias("tags"),
                           F.create_map(F.lit("l"), F.col("lang"), F.lit("s"), F.col("source")).alias("facts"))
    return flt.column_filters(d, {"tags": {"value": "7"}, "facts": {"value": "EN", "mode": "strict"}}).drop("tags", "facts")


@job("flt8_advanced_search", """
SELECT * FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_brand), '#1')
""")
def flt8_advanced_search(t):
    """FLT8: every given column contains its text."""
    return flt.advanced_search(t.part, {"p_name": "Ring", "p_brand": "#1"})


@job("flt9_fold_accents", """
SELECT doc_id, strip_accents(text) AS folded FROM documents
""")
def flt9_fold_accents(t):
    """FLT9: accent folding over all documents (whole texts)."""
    return t.documents.select("doc_id", fold_accents(F.col("text")).alias("folded"))


@job("flt9_accent_neutral_search", """
SELECT doc_id, lang FROM documents WHERE contains(lower(strip_accents(text)), 'etre')
""")
def flt9_accent_neutral_search(t):
    """FLT9: accent-insensitive search: 'Être' finds 'etre', 'être', 'ÊTRE' in whole documents."""
    d = t.documents.select("doc_id", "lang", "text")
    return flt.search(d, "Être", ["text"], accent_neutral=True).select("doc_id", "lang")


@job("flt10_dynamic_filter", """
SELECT * FROM events WHERE event_type = 'purchase' AND (user_id = 7 OR event_id = 100)
""")
def flt10_dynamic_filter(t):
    """FLT10: '&' keys must all match, at least one other key must match."""
    return flt.dynamic_filter(t.events, {"&event_type": "purchase", "user_id": 7, "event_id": 100})


@job("flt11_prefix_filter", "SELECT * FROM part WHERE starts_with(p_brand, 'Brand#1')")
def flt11_prefix_filter(t):
    """FLT11: prefix filter on a code column."""
    return flt.prefix_filter(t.part, "p_brand", "Brand#1")


@job("flt12_category_filter", "SELECT * FROM part WHERE p_type = 'SMALL'")
def flt12_category_filter(t):
    """FLT12: category filter ('all' keeps everything)."""
    return flt.category_filter(flt.category_filter(t.part, "p_size", "all"), "p_type", "SMALL")


@job("flt13_date_range", """
SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-08-01'
""")
def flt13_date_range(t):
    """FLT13: 'last_month' preset as of 1998-08-15, clamped to the data range."""
    return flt.date_range(t.orders, "o_orderdate", "last_month", dt.date(1998, 8, 15),
                          dt.date(1995, 1, 1), dt.date(2001, 8, 1), 31)


@job("flt13_date_range_events", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-21'
""")
def flt13_date_range_events(t):
    """FLT13: 'last_7_days' preset as of 2024-01-20."""
    return flt.date_range(t.events, "ts", "last_7_days", dt.date(2024, 1, 20),
                          dt.date(2024, 1, 1), dt.date(2024, 1, 30), 31)


@job("flt14_smart_search", """
SELECT * FROM part
WHERE regexp_matches(p_name || ' ' || p_type, 'bolt', 'i') AND regexp_matches(p_name || ' ' || p_type, 'small', 'i')
""")
def flt14_smart_search(t):
    """FLT14: smart search, words AND-ed in any order over the row text."""
    return flt.smart_search(t.part, "small bolt", ["p_name", "p_type"])


@job("flt14_boundary_search", """
SELECT * FROM part WHERE regexp_matches(p_name || ' ' || p_type, '\\bbo', 'i') AND regexp_matches(p_name || ' ' || p_type, '\\bsm', 'i')
""")
def flt14_boundary_search(t):
    """FLT14: every word must start at a word boundary."""
    return flt.smart_search(t.part, "bo sm", ["p_name", "p_type"], boundary=True)


@job("flt14_exact_and_regex", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND regexp_matches(c_name, '[05]$')
""")
def flt14_exact_and_regex(t):
    """FLT14: an exact search on one column, then a pattern on another."""
    exact = flt.smart_search(t.customer, "building", ["c_mktsegment"], exact=True)
    return flt.smart_search(exact, "[05]$", ["c_name"], regex=True).select("c_custkey", "c_mktsegment")


@job("flt15_all_words", """
SELECT doc_id,
       (strlen(lower(text)) - strlen(replace(lower(text), 'the', ''))) / 3 >= 1
   AND (strlen(lower(text)) - strlen(replace(lower(text), 'of', ''))) / 2 >= 1
   AND (strlen(lower(text)) - strlen(replace(lower(text), 'and', ''))) / 3 >= 2 AS matched
FROM documents
""")
def flt15_all_words(t):
    """FLT15: every query word found, each hit consumed once (whole texts)."""
    return flt.all_words(t.documents.select("doc_id", "text"), "the AND of and", "text").select("doc_id", "matched")


@job("prj1_project", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def prj1_project(t):
    """PRJ1: visible + forced - ignored columns."""
    return flt.project(t.customer, ["c_custkey", "c_name", "c_acctbal"], force=["c_mktsegment"], ignore=["c_acctbal"])


@job("prj2_path", "SELECT *, json_extract_string(props, '$.k') AS k FROM events")
def prj2_path(t):
    """PRJ2: nested path into JSON props with null propagation."""
    return flt.path(t.events, "k", out="k", json_col="props")


@job("prj3_format_rows", """
SELECT upper(n_name) AS name, n_name || ' (' || CAST(n_nationkey AS VARCHAR) || ')' AS label,
       n_regionkey AS region FROM nation
""")
def prj3_format_rows(t):
    """PRJ3: per-column formatters into display rows."""
    return flt.format_rows(t.nation, {
        "name": F.upper("n_name"),
        "label": F.concat("n_name", F.lit(" ("), F.col("n_nationkey").cast("string"), F.lit(")")),
        "region": F.col("n_regionkey"),
    })


@job("win3_first_per_key", """
SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1
""")
def win3_first_per_key(t):
    """WIN3: first order per customer by lowest order key."""
    return flt.first_per_key(t.orders, "o_custkey", "o_orderkey")
