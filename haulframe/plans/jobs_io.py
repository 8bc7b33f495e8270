"""Registered jobs: SRC1-SRC4, SNK1-SNK5.

Jobs that write first write under the session's shared checkpoint folder
(a fresh sub-folder per run) and return the read-back, so the check sees
what a reader of the written data sees.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.operators import kpi
from haulframe.plans import standins
from haulframe.plans.registry import job
from haulframe.session import scratch_path
from haulframe.sources import files, sinks


@job("src1_scan", "SELECT * FROM orders")
def src1_scan(t):
    """SRC1: full scan of a stored table, all columns."""
    return t.orders


@job("src1_scan_pruned", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'")
def src1_scan_pruned(t):
    """SRC1: scan with a pushed filter and a two-column projection (ReadSchema has two columns)."""
    li = t.lineitem
    return li.where(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select(
        "l_orderkey", "l_extendedprice")


ROUTE_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_shipdate", T.TimestampNTZType()),
])


def _write_routes(t) -> str:
    """Write lineitem as route CSV files; 'n/a' quantities mark unreadable rows."""
    li = t.lineitem
    bad = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    out = li.select("l_orderkey", "l_linenumber",
                    F.when(bad, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
                    F.col("l_shipdate").cast("string").alias("l_shipdate"))
    path = scratch_path(t.spark, "routes-csv")
    out.write.option("header", True).csv(path)
    return path


@job("src2_read_routes", """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linenumber = 7)
""")
def src2_read_routes(t):
    """SRC2: typed read of route CSV files; good rows."""
    good, _ = files.read_routes(t.spark, _write_routes(t), ROUTE_SCHEMA)
    return good


@job("src2_read_routes_bad", """
SELECT CAST(l_orderkey AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR) || ',n/a,' || CAST(l_shipdate AS VARCHAR)
         AS raw_line, l_orderkey, l_linenumber, CAST(NULL AS DOUBLE) AS l_quantity, l_shipdate
FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7
""")
def src2_read_routes_bad(t):
    """SRC2: rows set apart as malformed, with their raw line."""
    _, bad = files.read_routes(t.spark, _write_routes(t), ROUTE_SCHEMA)
    return bad


def _page_manifest(t):
    p = t.pages
    ctype = (F.when(F.col("url").contains("#"), F.lit(None))
             .when(F.col("url").startswith("https:"), F.lit("text/html")).otherwise(F.lit("text/plain")))
    return p.select("page_id", F.col("url").alias("name"), F.length("html").cast("bigint").alias("size"),
                    ctype.alias("content_type"))


@job("src3_gate_files", """
WITH m AS (SELECT page_id, url AS name, CAST(length(html) AS BIGINT) AS size,
                  CASE WHEN contains(url, '#') THEN NULL WHEN starts_with(url, 'https:') THEN 'text/html'
                       ELSE 'text/plain' END AS content_type FROM pages)
SELECT *, CASE WHEN content_type IS NULL THEN NULL
               WHEN content_type NOT IN ('text/html', 'text/csv') THEN 'unsupported_type'
               WHEN size > 10000 THEN 'too_large' END AS reason,
          CASE WHEN content_type IS NULL THEN true
               WHEN content_type NOT IN ('text/html', 'text/csv') THEN false
               WHEN size > 10000 THEN false ELSE true END AS accepted
FROM m
""")
def src3_gate_files(t):
    """SRC3: upload gate over a page manifest (type allowed and size within 10,000)."""
    return files.gate_files(_page_manifest(t), ["text/html", "text/csv"], 10000)


@job("src3_gate_folder", """
WITH c AS (SELECT c_nationkey AS k, strlen(c_name || ';' || c_mktsegment) + CASE c_nationkey % 3 WHEN 2 THEN 11 ELSE 0 END + 1 AS n FROM customer),
f AS (SELECT 'nation=' || k AS batch, CAST(sum(n) AS BIGINT) AS size,
             CASE k % 3 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'text/plain' ELSE 'application/json' END AS content_type FROM c GROUP BY k)
SELECT *, CASE WHEN content_type = 'text/plain' THEN 'unsupported_type' WHEN size > 20000 THEN 'too_large' END AS reason FROM f
""")
def src3_gate_folder(t):
    """SRC3: a folder of lists of customers, one file per nation in three formats, listed and gated by real types and sizes."""
    path = scratch_path(t.spark, "uploads")
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), F.concat_ws(";", "c_name", "c_mktsegment").alias("line"))
    for k, kind in enumerate(("csv", "text", "json")):
        # a nation's list is one file: the table is small next to the limit of a file
        rows.where(F.col("nation") % 3 == k).repartition("nation").write.partitionBy("nation").format(kind).save(f"{path}/{kind}")
    gated = files.gate_files(files.file_manifest(t.spark, path), ["text/csv", "application/json"], 20000)
    return gated.select("batch", "size", "content_type", "reason")


@job("src4_gate_batch", f"""
WITH m AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || '.txt' AS name, n_chars AS size, 'text/' || lang AS content_type,
                  source AS batch FROM documents),
c AS (SELECT batch, count(*) AS nb FROM m GROUP BY batch)
SELECT m.*, CASE WHEN c.nb > 60 THEN '{files.MSG_MAX_FILES}'
                 WHEN NOT (regexp_matches(content_type, '^text/(en|fr|de)$') OR regexp_matches(name, '^text/(en|fr|de)$'))
                   THEN '{files.MSG_TYPE}'
                 WHEN size > 60000 THEN '{files.MSG_TOO_LARGE}'
                 WHEN size < 200 THEN '{files.MSG_TOO_SMALL}' END AS error
FROM m JOIN c USING (batch)
""")
def src4_gate_batch(t):
    """SRC4: per-source upload batches: count, type, max and min size checks in that order."""
    d = t.documents
    m = d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
                 F.col("n_chars").alias("size"), F.concat(F.lit("text/"), F.col("lang")).alias("content_type"),
                 F.col("source").alias("batch"))
    return files.gate_batch(m, 60, "^text/(en|fr|de)$", 60000, 200).drop("accepted")


@job("snk1_write_by_client", """
SELECT *, CAST(o_custkey % 16 AS INTEGER) AS company_id FROM orders
""")
def snk1_write_by_client(t):
    """SNK1: orders stored in one folder per client (o_custkey % 16), all clients read back."""
    path = scratch_path(t.spark, "by-client")
    sinks.write_by_client(t.orders.withColumn("company_id", (F.col("o_custkey") % 16).cast("int")), path)
    return reduce(lambda a, b: a.unionByName(b), [sinks.read_client(t.spark, path, c) for c in range(16)])


@job("snk2_export_csv", """
SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation
UNION ALL SELECT 'total', CAST(count(*) AS VARCHAR), NULL FROM nation
""")
def snk2_export_csv(t):
    """SNK2: nation exported as fully quoted CSV with a footer row, read back."""
    path = scratch_path(t.spark, "export-csv")
    sinks.export_csv(t.nation, path, footer={"n_nationkey": F.lit("total"), "n_name": F.count(F.lit(1))})
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@job("snk3_export_tsv", """
SELECT concat_ws(chr(9), CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS VARCHAR),
       CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR)
            ELSE CAST(p_retailprice AS VARCHAR) END) AS value
FROM part
""")
def snk3_export_tsv(t):
    """SNK3: parts copied as tab-separated lines, read back."""
    path = scratch_path(t.spark, "export-tsv")
    sinks.export_tsv(t.part, path)
    return t.spark.read.text(path)


@job("snk4_export_json", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def snk4_export_json(t):
    """SNK4: suppliers exported as JSON lines, read back."""
    path = scratch_path(t.spark, "export-json")
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    sinks.export(s, "json", path)
    return t.spark.read.schema(s.schema).json(path)


@job("snk4_export_xml", "SELECT p_name, p_brand FROM part")
def snk4_export_xml(t):
    """SNK4: parts exported as XML with the key column excluded, read back."""
    path = scratch_path(t.spark, "export-xml")
    sinks.export(t.part.select("p_partkey", "p_name", "p_brand"), "xml", path, exclude=["p_partkey"])
    return t.spark.read.option("rowTag", "row").schema("p_name STRING, p_brand STRING").xml(path)


@job("snk4_export_basic_csv", """
SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 80
""")
def snk4_export_basic_csv(t):
    """SNK4: the third page of 40 orders exported as CSV (two columns), read back."""
    path = scratch_path(t.spark, "export-basic")
    sinks.export(t.orders, "csv", path, visible=["o_orderkey"], include=["o_orderstatus"], scope="basic",
                 page=([F.col("o_orderdate"), F.col("o_orderkey")], 3, 40))
    return t.spark.read.option("header", True).schema("o_orderkey BIGINT, o_orderstatus STRING").csv(path)


@job("snk4_export_selected_txt", """
SELECT c_custkey || chr(9) || c_name AS value FROM customer WHERE c_acctbal > 5000
""")
def snk4_export_selected_txt(t):
    """SNK4: selected customers exported as text lines, read back."""
    path = scratch_path(t.spark, "export-selected")
    c = t.customer.select("c_custkey", "c_name", (F.col("c_acctbal") > 5000).alias("picked"))
    sinks.export(c, "txt", path, exclude=["picked"], scope="selected", selected="picked")
    return t.spark.read.text(path)


def _snk5_sql() -> str:
    from haulframe.plans.jobs_kpi import KPI1_SELECT, KPI_BASE_SQL

    nl = "chr(10)"
    text = " || ".join([
        "'Dear ' || rep.client_name || ','", nl, nl,
        "'Your logistics performance for ' || strftime(rep.month, '%Y-%m') || ':'", nl,
        "'Shipments: ' || CAST(rep.shipments AS VARCHAR)", nl,
        "'Average delivery: ' || coalesce(CAST(rep.avgdelivery AS VARCHAR), 'n/a') || ' days'", nl,
        "'Change against the previous month: ' || coalesce(CAST(rep.percent_change AS VARCHAR), 'n/a') || '%'", nl,
        "'On-time delivery: ' || coalesce(CAST(rep.ontimedelivery AS VARCHAR), 'n/a') || '%'", nl,
        "'Main delay reasons: ' || coalesce(rep.delayreasons, 'none')", nl,
        "'Suggested revision: ' || coalesce(rep.suggested, 'none')", nl, nl, "' '"])
    subject = sinks.REPORT_SUBJECT.replace("'", "''")
    missing = ("error: " + sinks.MISSING_RECIPIENT).replace("'", "''")
    return KPI_BASE_SQL + f""", rep AS ({KPI1_SELECT}),
rcp AS (SELECT c_mktsegment AS client_name, arg_min(lower(c_name), c_custkey) || '@example.com' AS email
        FROM customer GROUP BY 1)
SELECT rep.client_name, rep.month, rcp.email AS recipient, '{subject}' AS subject, {text} AS text,
       CASE WHEN coalesce(trim(rcp.email), '') <> '' THEN 'ok' ELSE '{missing}' END AS status
FROM rep LEFT JOIN rcp USING (client_name)
"""


@job("snk5_render_report", _snk5_sql())
def snk5_render_report(t):
    """SNK5: one report message per client and month, addressed to the segment's first customer."""
    rep = kpi.monthly_report(standins.shipments(t))
    rcp = t.customer.groupBy(F.col("c_mktsegment").alias("client_name")).agg(
        F.min_by(F.lower("c_name"), "c_custkey").alias("email")).select(
        "client_name", F.concat(F.col("email"), F.lit("@example.com")).alias("email"))
    return sinks.render_report(rep, rcp)

