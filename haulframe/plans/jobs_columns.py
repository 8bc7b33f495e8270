"""Registered jobs: STR1-STR8, NUM1-NUM6, GEO1, DAT1-DAT7, JSN1 (scalar functions run as table jobs)."""

from __future__ import annotations

import datetime as dt
import math
from html.entities import html5

from pyspark.sql import functions as F

from haulframe.functions import dates, numbers
from haulframe.functions import strings as st
from haulframe.plans import standins
from haulframe.plans.registry import job

# ---------------------------------------------------------------------------
# DuckDB spellings shared by several oracle statements.


def _sql_replace_chain(expr: str, pairs) -> str:
    for a, b in pairs:
        a_ = a.replace("'", "''")
        b_ = b.replace("'", "''")
        expr = f"replace({expr}, '{a_}', '{b_}')"
    return expr


def _sql_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


# ---------------------------------------------------------------------------
# STR


@job("str1_norm_key", """
SELECT event_id AS arrival,
       lower(coalesce(nullif(CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_type END, ''), 'none'))
         AS company_key
FROM events
""")
def str1_norm_key(t):
    """STR1: company key normalised (missing -> 'none')."""
    r = standins.subscription_requests(t)
    return r.select("arrival", st.norm_key(F.col("cp_name")).alias("company_key"))


@job("str2_strip_html", f"""
SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text_plain,
       {_sql_trim("regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&[#A-Za-z0-9]+;', '', 'g')")} AS text_clean
FROM pages
""")
def str2_strip_html(t):
    """STR2: strip tags (plain) and tags + entities + trim (clean) over whole pages."""
    p = t.pages
    return p.select("page_id", st.strip_tags(F.col("html")).alias("text_plain"),
                    st.remove_html(F.col("html")).alias("text_clean"))


@job("str3_html_escape", f"""
SELECT doc_id, {_sql_replace_chain("text", st.HTML_ESCAPES)} AS escaped FROM documents
""")
def str3_html_escape(t):
    """STR3: escape the five HTML entities in whole documents."""
    return t.documents.select("doc_id", st.html_escape(F.col("text")).alias("escaped"))


@job("str3_html_unescape", f"""
SELECT page_id, {_sql_replace_chain("html", [(e, r) for r, e in st.HTML_ESCAPES])} AS unescaped FROM pages
""")
def str3_html_unescape(t):
    """STR3: unescape the five HTML entities ('&amp;' first) in whole pages."""
    return t.pages.select("page_id", st.html_unescape(F.col("html")).alias("unescaped"))


def _clean_sql(c: str) -> str:
    s = f"regexp_replace({c}, '(?is)<script\\b.*?</script>', '', 'g')"
    s = f"regexp_replace({s}, '<!--.*?-->', '', 'g')"
    s = f"regexp_replace({s}, '<[^>]*>', '', 'g')"
    s = f"replace({_sql_trim(s)}, chr(10), ' ')"
    # the references that the given pages can hold; the older names also stand without their semicolon
    pairs = st.EXPORT_ENTITIES + [(e, r) for r, e in st.HTML_ESCAPES if r != "&"] + [("&amp;", "&")]
    for ent, raw in pairs:
        bare = ent[1:-1] in html5 or ent[1] == "#"
        raw = raw.replace("'", "''")
        s = f"regexp_replace({s}, '{ent}{'?' if bare else ''}', '{raw}', 'g')"
    return s


@job("str4_clean_cell", f"""
WITH c AS (SELECT page_id, {_clean_sql('html')} AS s FROM pages)
SELECT page_id, CASE WHEN regexp_matches(s, '^[=+\\-@\\t\\r]') THEN '''' || s ELSE s END AS cell FROM c
""")
def str4_clean_cell(t):
    """STR4: export cleaning of whole pages (scripts, comments, tags, entities, formula guard)."""
    return t.pages.select("page_id", st.clean_cell(F.col("html")).alias("cell"))


@job("str5_slug", f"""
SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(
    translate(lower(text), '{st.TYPEAHEAD_ACCENT_FROM}', '{st.TYPEAHEAD_ACCENT_TO}'),
    '[^-a-z0-9]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug
FROM documents
""")
def str5_slug(t):
    """STR5: slugs of whole documents."""
    return t.documents.select("doc_id", st.slug(F.col("text")).alias("slug"))


@job("str6_highlight", """
SELECT p_partkey, regexp_replace(p_name, '(ring|red)', '<strong>\\1</strong>', 'gi') AS highlighted FROM part
""")
def str6_highlight(t):
    """STR6: highlight 'red' and 'ring' in part names (longest key first, not inside tags)."""
    return t.part.select("p_partkey", st.highlight(F.col("p_name"), ["red", "ring"]).alias("highlighted"))


@job("str7_basename", """
SELECT page_id, string_split(url, '/')[-1] AS file_name, replace(url, '.', '') AS label FROM pages
""")
def str7_basename(t):
    """STR7: file name of each page path and the URL without '.' delimiters."""
    p = t.pages
    return p.select("page_id", st.basename(F.col("url")).alias("file_name"),
                    st.strip_delim(F.col("url"), ".").alias("label"))


_LANGS = ["fr", "en", "de", "es"]


@job("str8_localized", """
WITH p AS (SELECT source, """ + ", ".join(
    f"arg_min(text, doc_id) FILTER (WHERE lang = '{lg}') AS t_{lg}" for lg in _LANGS) + """
           FROM documents GROUP BY source)
SELECT source, coalesce(""" + ", ".join(f"CASE WHEN trim(t_{lg}) <> '' THEN t_{lg} END" for lg in _LANGS) + """) AS text,
       CASE """ + " ".join(f"WHEN trim(t_{lg}) <> '' THEN '{lg}'" for lg in _LANGS) + """ END AS lang
FROM p
""")
def str8_localized(t):
    """STR8: per source, the first document in the first language of fr, en, de, es that has text."""
    d = t.documents
    p = d.groupBy("source").pivot("lang", _LANGS).agg(F.min_by("text", "doc_id"))
    lang = F.lit(None).cast("string")
    for lg in reversed(_LANGS):
        lang = F.when(F.trim(F.col(lg)) != "", F.lit(lg)).otherwise(lang)
    return p.select("source", st.localized([F.col(lg) for lg in _LANGS]).alias("text"), lang.alias("lang"))


# ---------------------------------------------------------------------------
# NUM, GEO

_LN10 = repr(math.log(10))


@job("num1_ticks", f"""
WITH e AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
s AS (SELECT *, pow(10.0, floor(ln((hi - lo) / 5) / {_LN10})) AS step0 FROM e WHERE hi - lo > 0),
s2 AS (SELECT *, 5 / (hi - lo) * step0 AS err FROM s),
s3 AS (SELECT *, CASE WHEN err <= 0.15 THEN step0 * 10 WHEN err <= 0.35 THEN step0 * 5
                      WHEN err <= 0.75 THEN step0 * 2 ELSE step0 END AS step FROM s2),
s4 AS (SELECT *, floor(lo / step) * step AS t0, ceil(hi / step) * step AS t1 FROM s3),
s5 AS (SELECT *, CAST(round((t1 - t0) / step) AS INTEGER) AS n FROM s4),
g AS (SELECT *, unnest(generate_series(0, n)) AS i FROM s5)
SELECT l_returnflag, CAST(i AS INTEGER) AS tick_no, round(t0 + i * step, 10) AS label,
       CASE WHEN i = 0 THEN lo WHEN i = n THEN hi ELSE round(t0 + i * step, 10) END AS value,
       round(step, 10) AS step
FROM g
""")
def num1_ticks(t):
    """NUM1: round axis ticks of price per return flag."""
    return numbers.ticks(t.lineitem, "l_extendedprice", ["l_returnflag"])


@job("num2_linear_bins", """
WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
s AS (SELECT lo, round((((hi - lo) / 10) + 2.220446049250313e-16) * 100) / 100 AS step FROM m),
b AS (SELECT CAST(least(greatest(floor((l_extendedprice - lo) / step), 0), 9) AS INTEGER) AS bin, lo, step
      FROM lineitem, s WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(any_value(lo) + bin * any_value(step), 2) AS bin_start,
       round(any_value(lo) + (bin + 1) * any_value(step), 2) AS bin_end, count(*) AS n
FROM b GROUP BY bin
""")
def num2_linear_bins(t):
    """NUM2: ten linear price bins (step rounded to cents) with counts."""
    return numbers.linear_bins(t.lineitem, "l_extendedprice", 10)


@job("num3_log_bins", """
WITH p AS (SELECT k AS exponent, pow(10.0, k) AS lower_bound FROM (SELECT CAST(unnest(range(-9, 16)) AS INTEGER) AS k))
SELECT p.exponent, p.lower_bound, count(*) AS n
FROM orders o LEFT JOIN p ON o.o_totalprice >= p.lower_bound AND o.o_totalprice < p.lower_bound * 10 GROUP BY 1, 2
""")
def num3_log_bins(t):
    """NUM3: order totals in powers-of-ten bins."""
    return numbers.log_bins(t.orders, "o_totalprice", 10.0)


@job("num4_log_norm", """
WITH e AS (SELECT o_orderpriority, log10(min(o_totalprice)) AS a, log10(max(o_totalprice)) AS b FROM orders GROUP BY 1)
SELECT o.o_orderkey, o.o_orderpriority, o.o_totalprice, round((log10(o.o_totalprice) - e.a) / (e.b - e.a), 8) AS log_value
FROM orders o JOIN e USING (o_orderpriority)
""")
def num4_log_norm(t):
    """NUM4: order totals log-normalised to their priority's extent."""
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    r = numbers.log_norm(o, "o_orderpriority", "o_totalprice", 10.0)
    return r.withColumn("log_value", F.round("log_value", 8))


_STOPS = ["#C8EEFF", "#0071A4"]


def _color_sql() -> str:
    v0 = numbers._rgb(_STOPS[0])
    v1 = numbers._rgb(_STOPS[1])
    length = math.dist(v1, v0)
    e = numbers.POLYNOMIAL_EXPONENT
    chans = []
    for k in range(3):
        ch = f"(CAST({float(v0[k])!r} AS DOUBLE) + {float(v1[k] - v0[k])!r} * ((v - 0.0 * c) / ({length!r} * c)))"
        chans.append(f"floor({ch} + 0.5) * {256 ** (2 - k)}")
    seg0 = " + ".join(chans)
    last = float(v1[0] * 65536 + v1[1] * 256 + v1[2])
    return f"""
WITH v AS (SELECT 'N' || CAST(c.c_nationkey AS VARCHAR) AS code, sum(o.o_totalprice) AS revenue
           FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1),
m AS (SELECT pow(min(revenue), {e!r}) AS lo, pow(max(revenue), {e!r}) AS hi FROM v),
x AS (SELECT code, revenue, pow(revenue, {e!r}) - lo AS v, (hi - lo) / {length!r} AS c FROM v, m),
n AS (SELECT code, revenue, CASE WHEN v - {length!r} * c >= 0 THEN {last!r} ELSE {seg0} END AS num FROM x)
SELECT code, round(revenue, 2) AS revenue,
       CASE WHEN revenue IS NOT NULL THEN '#' || lpad(lower(hex(CAST(num AS BIGINT))), 6, '0') END AS color
FROM n
"""


@job("num5_color_scale", _color_sql())
def num5_color_scale(t):
    """NUM5: choropleth colour of each nation's revenue (x^0.2 scale, two-stop ramp)."""
    v = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
         .groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("code"))
         .agg(F.sum("o_totalprice").alias("revenue")))
    r = numbers.color_scale(v, "revenue", _STOPS, "polynomial")
    return r.select("code", F.round("revenue", 2).alias("revenue"), "color")


_BANDS = [(0.0, 100.0, "low"), (50.0, 200.0, "mid"), (200.0, 1000.0, "high")]


@job("num6_band", """
WITH m AS (SELECT min(value) AS mn, max(value) AS mx FROM events)
SELECT event_id, value,
       CASE """ + " ".join(f"WHEN value >= {lo} AND value <= {hi} THEN '{n}'" for lo, hi, n in reversed(_BANDS)) + """
       END AS band,
       round(100.0 * value / (CASE """ + " ".join(
    f"WHEN value BETWEEN {lo} AND {hi} THEN {lo + hi}" for lo, hi, _ in reversed(_BANDS)) + """ ELSE abs(mx) + abs(mn) END), 6) AS percent
FROM events, m
""")
def num6_band(t):
    """NUM6: value band (last matching range wins) and percent of the extent."""
    r = numbers.band(t.events.select("event_id", "value"), "value", _BANDS)
    return r.withColumn("percent", F.round("percent", 6))


@job("num6_band_table", """
WITH r AS (SELECT p_partkey AS position, (p_retailprice - 900) * 5 AS lo, (p_retailprice - 900) * 5 + p_size AS hi, p_brand AS label
           FROM part),
m AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
w AS (SELECT e.event_id, e.value, max(position) AS position, arg_max(label, position) AS band,
             arg_max(abs(lo) + abs(hi), position) AS whole
      FROM events e LEFT JOIN r ON e.value >= r.lo AND e.value <= r.hi GROUP BY 1, 2)
SELECT event_id, value, band,
       round(100.0 * value / (CASE WHEN position IS NULL THEN abs(mx) + abs(mn) ELSE whole END), 6) AS percent
FROM w, m
""")
def num6_band_table(t):
    """NUM6: event values labelled by a table of overlapping price ranges, one for each part (the last part wins)."""
    low = (F.col("p_retailprice") - 900) * 5
    ranges = t.part.select(F.col("p_partkey").alias("position"), low.alias("from"), (low + F.col("p_size")).alias("to"),
                           F.col("p_brand").alias("label"))
    r = numbers.band_table(t.events.select("event_id", "value"), "value", ranges)
    return r.withColumn("percent", F.round("percent", 6))


_RAD = math.pi / 180


def _markers(t):
    c = t.customer
    return c.select("c_custkey", ((F.col("c_custkey") % 1400) / 10.0 - 70).alias("lat"),
                    (F.col("c_nationkey") * 14.4 - 180).alias("lon"))


_MARKERS_SQL = ("SELECT c_custkey, CAST((c_custkey % 1400) / 10.0 - 70 AS DOUBLE) AS lat, "
                "CAST(c_nationkey * 14.4 - 180 AS DOUBLE) AS lon FROM customer")


@job("geo1_project_mill", f"""
SELECT c_custkey, lat, lon, round((lon - 0.0) * {numbers.MAP_RADIUS * _RAD!r}, 3) AS x,
       round((-{numbers.MAP_RADIUS} * ln(tan((45.0 + lat * 0.4) * {_RAD!r}))) / 0.8, 3) AS y
FROM ({_MARKERS_SQL})
""")
def geo1_project_mill(t):
    """GEO1: customer markers projected with Miller."""
    r = numbers.project_points(_markers(t), "lat", "lon", "mill")
    return r.withColumn("x", F.round("x", 3)).withColumn("y", F.round("y", 3))


@job("geo1_project_merc", f"""
SELECT c_custkey, lat, lon, round((lon - 0.0) * {numbers.MAP_RADIUS * _RAD!r}, 3) AS x,
       round(-{numbers.MAP_RADIUS} * ln(tan({math.pi / 4!r} + lat * {math.pi / 360!r})), 3) AS y
FROM ({_MARKERS_SQL})
""")
def geo1_project_merc(t):
    """GEO1: customer markers projected with Mercator."""
    r = numbers.project_points(_markers(t), "lat", "lon", "merc")
    return r.withColumn("x", F.round("x", 3)).withColumn("y", F.round("y", 3))


def _aea_consts():
    p1, p2 = (p * _RAD for p in numbers.ALBERS_PARALLELS)
    n = (math.sin(p1) + math.sin(p2)) / 2
    cc = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    return n, cc, math.sqrt(cc) / n


_AN, _AC, _ARO0 = _aea_consts()


@job("geo1_project_aea", f"""
WITH m AS ({_MARKERS_SQL}),
r AS (SELECT *, sqrt({_AC!r} - sin(lat * {_RAD!r}) * {2 * _AN!r}) / {_AN!r} AS ro,
             (lon * {_RAD!r} - {0.0 * _RAD!r}) * {_AN!r} AS theta FROM m)
SELECT c_custkey, lat, lon, round(ro * sin(theta) * {numbers.MAP_RADIUS}, 3) AS x,
       round(-({_ARO0!r} - ro * cos(theta)) * {numbers.MAP_RADIUS}, 3) AS y
FROM r
""")
def geo1_project_aea(t):
    """GEO1: customer markers projected with the Albers equal-area conic."""
    r = numbers.project_points(_markers(t), "lat", "lon", "aea")
    return r.withColumn("x", F.round("x", 3)).withColumn("y", F.round("y", 3))


def _lcc_consts():
    p1, p2 = (p * _RAD for p in numbers.LAMBERT_PARALLELS)
    n = math.log(math.cos(p1) / math.cos(p2)) / math.log(math.tan(math.pi / 4 + p2 / 2) / math.tan(math.pi / 4 + p1 / 2))
    f = math.cos(p1) * math.tan(math.pi / 4 + p1 / 2) ** n / n
    return n, f


_N, _F = _lcc_consts()


@job("geo1_project_lcc", f"""
WITH m AS ({_MARKERS_SQL}),
r AS (SELECT *, {_F!r} * pow(1.0 / tan({math.pi / 4!r} + lat * {_RAD!r} / 2), {_N!r}) AS ro,
             (lon * {_RAD!r} - {0.0 * _RAD!r}) * {_N!r} AS ang FROM m)
SELECT c_custkey, lat, lon, round(ro * sin(ang) * {numbers.MAP_RADIUS}, 3) AS x,
       round(-({_F!r} - ro * cos(ang)) * {numbers.MAP_RADIUS}, 3) AS y
FROM r
""")
def geo1_project_lcc(t):
    """GEO1: customer markers projected with the Lambert conformal conic."""
    r = numbers.project_points(_markers(t), "lat", "lon", "lcc")
    return r.withColumn("x", F.round("x", 3)).withColumn("y", F.round("y", 3))


# ---------------------------------------------------------------------------
# DAT

_DAT1_UNITS = ["year", "quarter", "month", "week", "isoweek"]


def _start_sql(c: str, unit: str) -> str:
    if unit == "week":
        return f"(date_trunc('week', {c} + INTERVAL 1 DAY) - INTERVAL 1 DAY)"
    if unit == "isoweek":
        return f"date_trunc('week', {c})"
    return f"date_trunc('{unit}', {c})"


_NEXT_SQL = {"year": "INTERVAL 1 YEAR", "quarter": "INTERVAL 3 MONTH", "month": "INTERVAL 1 MONTH",
             "week": "INTERVAL 7 DAY", "isoweek": "INTERVAL 7 DAY", "day": "INTERVAL 1 DAY",
             "hour": "INTERVAL 1 HOUR"}


def _end_sql(c: str, unit: str) -> str:
    return f"({_start_sql(c, unit)} + {_NEXT_SQL[unit]} - INTERVAL 1 MILLISECOND)"


@job("dat1_start_end_of", "SELECT o_orderkey, " + ", ".join(
    f"CAST({_start_sql('o_orderdate', u)} AS TIMESTAMP) AS start_{u}, CAST({_end_sql('o_orderdate', u)} AS TIMESTAMP) AS end_{u}"
    for u in _DAT1_UNITS) + " FROM orders")
def dat1_start_end_of(t):
    """DAT1: start and end of year, quarter, month, week (Sunday) and ISO week of each order date."""
    o = t.orders
    cols = []
    for u in _DAT1_UNITS:
        cols += [dates.start_of(F.col("o_orderdate"), u).alias(f"start_{u}"),
                 dates.end_of(F.col("o_orderdate"), u).alias(f"end_{u}")]
    return o.select("o_orderkey", *cols)


@job("dat2_shift", """
SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL (-2) DAY + to_milliseconds(90061001) AS shifted FROM orders
""")
def dat2_shift(t):
    """DAT2: order date + 1 month (day clamped) - 2 days + 1d 1h 1m 1.001s."""
    return t.orders.select("o_orderkey", dates.shift(F.col("o_orderdate"), 1, -2, 90061001).alias("shifted"))


_DAT3_SQL = """
WITH j AS (SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate AS a, o.o_orderdate AS b
           FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
p AS (SELECT *, CASE WHEN day(a) < day(b) THEN 1 ELSE -1 END AS sign,
             CASE WHEN day(a) < day(b) THEN b ELSE a END AS origin, CASE WHEN day(a) < day(b) THEN a ELSE b END AS other FROM j),
n AS (SELECT *, CAST(datediff('month', origin, other) AS INTEGER) AS apart FROM p),
m AS (SELECT *, apart - CAST(origin + to_months(apart) > other AS INTEGER) AS low FROM n),
s AS (SELECT *, sign * (low + (epoch_ms(other) - epoch_ms(origin + to_months(low)))
                              / (epoch_ms(origin + to_months(low + 1)) - epoch_ms(origin + to_months(low)))) + 0.0 AS months_f,
             (epoch_ms(a) - epoch_ms(b)) / 864e5 AS days_f, (epoch_ms(a) - epoch_ms(b)) / 6048e5 AS weeks_f FROM m)
SELECT l_orderkey, l_linenumber, CAST(trunc(months_f) AS BIGINT) AS months, round(months_f, 8) AS months_float,
       CAST(trunc(days_f) AS BIGINT) AS days, round(weeks_f, 8) AS weeks_float
FROM s
"""


@job("dat3_diff", _DAT3_SQL)
def dat3_diff(t):
    """DAT3: ship date - order date in whole and fractional months, days and weeks."""
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.col("l_shipdate"), F.col("o_orderdate")
    return j.select("l_orderkey", "l_linenumber",
                    dates.diff(a, b, "month").alias("months"),
                    F.round(dates.diff(a, b, "month", True), 8).alias("months_float"),
                    dates.diff(a, b, "day").alias("days"),
                    F.round(dates.diff(a, b, "week", True), 8).alias("weeks_float"))


_LO, _HI = "2024-01-10 12:00:00", "2024-01-20 00:00:00"


@job("dat4_between", f"""
SELECT event_id, ts,
  ({_start_sql('ts', 'day')} > TIMESTAMP '{_LO}') AND ({_end_sql('ts', 'day')} < TIMESTAMP '{_HI}') AS day_open,
  NOT ({_end_sql('ts', 'day')} < TIMESTAMP '{_LO}') AND ({_end_sql('ts', 'day')} < TIMESTAMP '{_HI}') AS day_left_closed,
  NOT ({_end_sql('ts', 'hour')} < TIMESTAMP '{_LO}') AND NOT ({_start_sql('ts', 'hour')} > TIMESTAMP '{_HI}') AS hour_closed
FROM events
""")
def dat4_between(t):
    """DAT4: is the event between two instants at day / hour granularity with different bounds."""
    e = t.events.select("event_id", "ts")
    lo, hi = dt.datetime(2024, 1, 10, 12), dt.datetime(2024, 1, 20)
    return e.select("event_id", "ts",
                    dates.is_between(F.col("ts"), lo, hi, "day", "()").alias("day_open"),
                    dates.is_between(F.col("ts"), lo, hi, "day", "[)").alias("day_left_closed"),
                    dates.is_between(F.col("ts"), lo, hi, "hour", "[]").alias("hour_closed"))


def _auto_bucket_sql(table: str, ts: str) -> str:
    return f"""
WITH m AS (SELECT (epoch_ms(max({ts})) - epoch_ms(min({ts}))) / 864e5 AS d FROM {table}),
c AS (SELECT CASE WHEN d / 365 > 5 THEN 'years' WHEN d > 800 THEN 'half_year' WHEN d > 180 THEN 'months'
                  WHEN d > 90 THEN 'months_fortnight' WHEN d > 60 THEN 'months_days' WHEN d > 30 THEN 'week_days'
                  WHEN d > 2 THEN 'days' WHEN d * 24 > 2.4 THEN 'hours' WHEN d * 1440 > 15 THEN 'minutes_fives'
                  WHEN d * 1440 > 5 THEN 'minutes' WHEN d * 1440 > 1 THEN 'seconds_tens'
                  WHEN d * 86400 > 20 THEN 'seconds_fives' ELSE 'seconds' END AS name FROM m)
SELECT name AS interval,
  CAST(CASE name WHEN 'years' THEN date_trunc('year', {ts})
    WHEN 'half_year' THEN make_timestamp(year({ts}), CASE WHEN month({ts}) <= 6 THEN 1 ELSE 7 END, 1, 0, 0, 0)
    WHEN 'months' THEN date_trunc('month', {ts})
    WHEN 'months_fortnight' THEN CASE WHEN day({ts}) < 16 THEN date_trunc('month', {ts})
                                      ELSE date_trunc('month', {ts}) + INTERVAL 15 DAY END
    WHEN 'months_days' THEN date_trunc('week', {ts})
    WHEN 'week_days' THEN date_trunc('day', {ts}) WHEN 'days' THEN date_trunc('day', {ts})
    WHEN 'hours' THEN date_trunc('hour', {ts})
    WHEN 'minutes_fives' THEN to_timestamp(floor(epoch({ts}) / 300) * 300)::TIMESTAMP
    WHEN 'minutes' THEN date_trunc('minute', {ts})
    WHEN 'seconds_tens' THEN to_timestamp(floor(epoch({ts}) / 10) * 10)::TIMESTAMP
    WHEN 'seconds_fives' THEN to_timestamp(floor(epoch({ts}) / 5) * 5)::TIMESTAMP
    ELSE date_trunc('second', {ts}) END AS TIMESTAMP) AS bucket,
  count(*) AS n
FROM {table}, c GROUP BY 1, 2
"""


@job("dat5_auto_bucket_events", _auto_bucket_sql("events", "ts"))
def dat5_auto_bucket_events(t):
    """DAT5: events counted per automatically chosen bucket (a 30-day span gives days)."""
    return dates.auto_bucket(t.events.select("ts"), "ts")


@job("dat5_auto_bucket_orders", _auto_bucket_sql("orders", "o_orderdate"))
def dat5_auto_bucket_orders(t):
    """DAT5: orders counted per automatically chosen bucket (a multi-year span gives years)."""
    return dates.auto_bucket(t.orders.select("o_orderdate"), "o_orderdate")


def _breakdown_sql(units: str) -> str:
    """Whole months by comparing (day, time) within the shorter month, the rest as seconds (all units from W shown)."""
    years = "m // 12" if "Y" in units else "0"
    rest, parts = "rest", []
    for name, size in (("weeks", 604800), ("days", 86400), ("hours", 3600), ("minutes", 60), ("seconds", 1)):
        parts.append(f"CASE WHEN until < nw THEN 0 ELSE CAST(floor({rest} / {size}) AS BIGINT) END AS {name}")
        rest = f"(({rest}) - floor(({rest}) / {size}) * {size})"
    return f"""
WITH j AS (SELECT l.l_orderkey, l.l_linenumber, date_trunc('second', o.o_orderdate) AS nw, l.l_shipdate AS until
           FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
c AS (SELECT *, least(day(last_day(nw)), day(last_day(until))) AS cap FROM j),
w AS (SELECT *, greatest(0, datediff('month', nw, until) - CASE
        WHEN row(least(day(until), cap), date_trunc('second', until)::TIME) < row(least(day(nw), cap), nw::TIME) THEN 1 ELSE 0 END) AS m FROM c),
s AS (SELECT *, CASE WHEN nw::DATE = last_day(nw) THEN last_day(nw + to_months(CAST(m AS INTEGER))) + nw::TIME
                     ELSE nw + to_months(CAST(m AS INTEGER)) END AS moved FROM w),
r AS (SELECT *, floor((epoch_ms(until) - epoch_ms(moved)) / 1000) AS rest FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN until < nw THEN 0 ELSE CAST({years} AS BIGINT) END AS years,
       CASE WHEN until < nw THEN 0 ELSE CAST(m - ({years}) * 12 AS BIGINT) END AS months, {", ".join(parts)}
FROM r
"""


def _breakdown_job(t, units):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")
    r = dates.breakdown(j, "o_orderdate", "l_shipdate", units)
    return r.select("l_orderkey", "l_linenumber", *dates.BREAKDOWN_NAMES)


@job("dat6_breakdown", _breakdown_sql("YOWDHMS"))
def dat6_breakdown(t):
    """DAT6: order-to-ship interval broken into years, months, weeks, days, h, m, s."""
    return _breakdown_job(t, "YOWDHMS")


@job("dat6_breakdown_no_years", _breakdown_sql("OWDHMS"))
def dat6_breakdown_no_years(t):
    """DAT6: the same without years (months absorb them)."""
    return _breakdown_job(t, "OWDHMS")


@job("dat6_breakdown_no_seconds", """
WITH j AS (SELECT l.l_orderkey, l.l_linenumber, epoch_ms(l.l_shipdate) - epoch_ms(date_trunc('second', o.o_orderdate)) AS ms
           FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
m AS (SELECT *, CASE WHEN ms < 0 THEN 0 ELSE CAST(ceil(floor(ms / 1000) / 60) AS BIGINT) END AS minutes_all FROM j)
SELECT l_orderkey, l_linenumber, 0 AS years, 0 AS months, 0 AS weeks, minutes_all // 1440 AS days,
       minutes_all % 1440 // 60 AS hours, minutes_all % 60 AS minutes, 0 AS seconds FROM m
""")
def dat6_breakdown_no_seconds(t):
    """DAT6: days, hours and minutes only, a started minute counting as one."""
    return _breakdown_job(t, "DHM")


def _age_sql(as_of: str) -> str:
    d = f"abs(epoch_ms(ts) - epoch_ms(TIMESTAMP '{as_of}'))"
    r = dates.REL_THRESHOLDS
    ph = dates.REL_PHRASES

    def f(k, n=None):
        p = ph[k].replace("'", "''")
        return f"'{p}'" if n is None else f"replace('{p}', '%d', CAST(CAST({n} AS BIGINT) AS VARCHAR))"

    return f"""
WITH a AS (SELECT event_id, ts, epoch_ms(ts) - epoch_ms(TIMESTAMP '{as_of}') AS ms,
                  floor({d} / 1e3 + 0.5) AS secs, floor({d} / 6e4 + 0.5) AS mins, floor({d} / 36e5 + 0.5) AS hours,
                  floor({d} / 864e5 + 0.5) AS days,
                  floor({d} / 864e5 * {dates.MONTHS_PER_400_YEARS} / {dates.DAYS_PER_400_YEARS} + 0.5) AS months,
                  floor({d} / 864e5 * {dates.MONTHS_PER_400_YEARS} / {dates.DAYS_PER_400_YEARS} / 12 + 0.5) AS years
           FROM events),
b AS (SELECT *, CASE WHEN secs <= {r['ss']} THEN {f('s')} WHEN secs < {r['s']} THEN {f('ss', 'secs')}
                     WHEN mins <= 1 THEN {f('m')} WHEN mins < {r['m']} THEN {f('mm', 'mins')}
                     WHEN hours <= 1 THEN {f('h')} WHEN hours < {r['h']} THEN {f('hh', 'hours')}
                     WHEN days <= 1 THEN {f('d')} WHEN days < {r['d']} THEN {f('dd', 'days')}
                     WHEN months <= 1 THEN {f('M')} WHEN months < {r['M']} THEN {f('MM', 'months')}
                     WHEN years <= 1 THEN {f('y')} ELSE {f('yy', 'years')} END AS txt FROM a)
SELECT event_id, ts, CASE WHEN ms > 0 THEN replace('{dates.REL_FUTURE}', '%s', txt)
                          ELSE replace('{dates.REL_PAST}', '%s', txt) END AS age
FROM b
"""


@job("dat7_age_label", _age_sql("2024-01-15 12:00:00"))
def dat7_age_label(t):
    """DAT7: relative age label of each event from 2024-01-15 12:00 ('3 days ago', 'in 2 hours')."""
    e = t.events.select("event_id", "ts")
    as_of = dates.instant("2024-01-15 12:00:00")
    return e.select("event_id", "ts", dates.age_label(as_of, F.col("ts")).alias("age"))


# ---------------------------------------------------------------------------
# JSN1


@job("jsn1_json", """
SELECT event_id, json_extract_string(props, '$.k') AS k,
       to_json(struct_pack(event_id := event_id, user_id := user_id, event_type := event_type)) AS row_json
FROM events
""")
def jsn1_json(t):
    """JSN1: JSON field access and rows as JSON text."""
    e = t.events
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"),
                    F.to_json(F.struct("event_id", "user_id", "event_type")).alias("row_json"))


@job("jsn1_row_equality", """
SELECT to_json(struct_pack(user_id := user_id, event_type := event_type)) AS row_json, count(*) AS copies
FROM events GROUP BY 1 HAVING count(*) > 1
""")
def jsn1_row_equality(t):
    """JSN1: whole-row equality by JSON text: repeated (user, type) rows and their copy counts."""
    j = t.events.select(F.to_json(F.struct("user_id", "event_type")).alias("row_json"))
    return j.groupBy("row_json").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
