"""SNK1-SNK5: writers for client folders, CSV / TSV / JSON / XML exports and report messages.

Writers never collect: every export is a distributed write; callers that
need a single file coalesce a result they know to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.functions.strings import clean_cell, js_text

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: the report e-mail subject and
# the error raised when a report has no recipient.
REPORT_SUBJECT = "🚀 Your Monthly Logistics Performance Report is Here"
MISSING_RECIPIENT = "The 'to_email' address must be provided and cannot be empty."
# ---------------------------------------------------------------------------


def write_by_client(df: DataFrame, path: str, client_col: str = "company_id", mode: str = "overwrite") -> None:
    """SNK1: one folder per client (Hive-style partition ``company_id=<id>``).

    Rows are range-partitioned on (client, row hash): each client's rows
    sit in consecutive tasks, so a folder gets few files, and the sampled
    range bounds split a client holding a third of the rows over many
    tasks instead of one.  The hash is of the row content, so a retried
    task sends every row to the same place.
    """
    salt = F.xxhash64(*[F.col(c) for c in df.columns])
    df.repartitionByRange(F.col(client_col), salt).write.mode(mode).partitionBy(client_col).parquet(path)


def read_client(spark: SparkSession, path: str, client_id, client_col: str = "company_id") -> DataFrame:
    """Read back one client's folder; the partition filter prunes all other folders."""
    return spark.read.parquet(path).where(F.col(client_col) == client_id)


def export_csv(df: DataFrame, path: str, footer: dict[str, Column] | None = None, clean: bool = True) -> None:
    """SNK2: header, every cell quoted, quotes doubled, comma separated, optional footer row.

    Cells go through the export cleaning (STR4) so formula-like cells are
    guarded.  The footer is one more row computed by an aggregate.
    """
    cols = [clean_cell(js_text(F.col(c), t)).alias(c) if clean else F.col(c).cast("string").alias(c)
            for c, t in ((f.name, f.dataType) for f in df.schema.fields)]
    out = df.select(*cols)
    if footer:
        # a union keeps partition order, so the one-row footer lands in the last part file
        frow = df.agg(*[footer.get(c, F.lit(None)).cast("string").alias(c) for c in df.columns])
        out = out.unionByName(frow)
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def tsv_line(df: DataFrame) -> Column:
    """SNK3: the copy-rows line: cell texts joined by tabs, null cells left out."""
    return F.concat_ws("\t", *[js_text(F.col(f.name), f.dataType) for f in df.schema.fields])


def export_tsv(df: DataFrame, path: str) -> None:
    df.select(tsv_line(df).alias("value")).write.mode("overwrite").text(path)


def export(df: DataFrame, fmt: str, path: str, include: list[str] | None = None,
           exclude: list[str] | None = None, visible: list[str] | None = None, scope: str = "all",
           page: tuple[list[Column], int, int] | None = None, selected: str | None = None) -> None:
    """SNK4: export in json / xml / csv / txt.

    scope: 'all' rows, 'basic' = one page (``page`` = (order, number, size)),
    'selected' = rows whose boolean column ``selected`` is true.  Columns are
    the visible ones plus ``include`` minus ``exclude``.
    """
    d = df
    if scope == "basic":
        from haulframe.operators.ordering import page as take_page

        order, number, size = page
        d = take_page(df, order, number, size).select(*df.columns)
    elif scope == "selected":
        d = df.where(F.coalesce(F.col(selected), F.lit(False)))
    keep = set(visible if visible is not None else df.columns) | set(include or [])
    cols = [c for c in df.columns if c in keep and c not in set(exclude or [])]
    d = d.select(*cols)
    w = d.write.mode("overwrite")
    if fmt == "json":
        w.json(path)
    elif fmt == "xml":
        w.option("rowTag", "row").option("rootTag", "rows").xml(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "txt":
        d.select(tsv_line(d).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(fmt)


def render_report(report: DataFrame, recipients: DataFrame, contact: str = "", phone: str = "") -> DataFrame:
    """SNK5: one message per report row: recipient, subject, plain text and a status.

    report: client_name, month, shipments, avgdelivery, percent_change,
    ontimedelivery, delayreasons, suggested; recipients: client_name, email.
    A row without a recipient becomes an error row (the reference raises).
    Sending is not part of the job: write the result and hand it to a mailer.
    """
    j = report.join(recipients, "client_name", "left")
    text = F.format_string(
        "Dear %s,\n\nYour logistics performance for %s:\n"
        "Shipments: %s\nAverage delivery: %s days\nChange against the previous month: %s%%\n"
        "On-time delivery: %s%%\nMain delay reasons: %s\nSuggested revision: %s\n\n%s %s",
        F.col("client_name"), F.date_format("month", "yyyy-MM"), F.col("shipments").cast("string"),
        F.coalesce(F.col("avgdelivery").cast("string"), F.lit("n/a")),
        F.coalesce(F.col("percent_change").cast("string"), F.lit("n/a")),
        F.coalesce(F.col("ontimedelivery").cast("string"), F.lit("n/a")),
        F.coalesce("delayreasons", F.lit("none")), F.coalesce("suggested", F.lit("none")),
        F.lit(contact), F.lit(phone))
    has_to = F.coalesce(F.trim(F.col("email")), F.lit("")) != ""
    return j.select("client_name", "month", F.col("email").alias("recipient"),
                    F.lit(REPORT_SUBJECT).alias("subject"), text.alias("text"),
                    F.when(has_to, F.lit("ok")).otherwise(F.lit("error: " + MISSING_RECIPIENT)).alias("status"))
