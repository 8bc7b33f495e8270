"""KPI1-KPI7: the monthly logistics report and the dashboard figures.

All of them aggregate first (partial aggregation runs map-side, so a hot
client or month does not pile raw rows into one task) and only then use
windows or joins on the small aggregated tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulframe.operators.nullsafe import join_on
from haulframe.plans.standins import SLA_DAYS
from haulframe.session import ensure_checkpoint_dir, materialize


def _late(sla: int):
    return F.col("delivery_days") > F.lit(sla)


# grouping sets of the report facts, by grouping_id()
_SETS = {
    "month": ["client", "month"],
    "reason": ["client", "month", "reason"],
    "route": ["client", "route"],
    "carrier": ["client", "carrier"],
}
_KEYS = ["client", "month", "reason", "route", "carrier"]


def _gid(level: str) -> int:
    """grouping_id() of a set: bit i (from the left, of _KEYS) is 1 when key i is rolled up."""
    cols = _SETS[level]
    return sum(1 << (len(_KEYS) - 1 - i) for i, k in enumerate(_KEYS) if k not in cols)


def report_facts(shipments: DataFrame, sla: int = SLA_DAYS) -> DataFrame:
    """Every figure the report needs, from ONE pass over the shipments.

    A single aggregate over four grouping sets ((client, month),
    (client, month, reason), (client, route), (client, carrier)): Spark
    expands each row four ways and combines map-side before the one
    shuffle, so the five-way join feeding it runs once.  Columns: the keys,
    ``level`` (month | reason | route | carrier), n (rows), n_valid (rows
    with a delivery time), sum_days, n_ontime, n_late.
    """
    d = shipments.select(
        "client", F.trunc(F.col("shipped_at").cast("date"), "MM").alias("month"), "reason", "route", "carrier",
        "delivery_days")
    valid = F.col("delivery_days").isNotNull()
    g = d.groupingSets([[F.col(c) for c in v] for v in _SETS.values()], *[F.col(k) for k in _KEYS]).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("delivery_days").alias("n_valid"),
        F.sum("delivery_days").alias("sum_days"),
        F.sum((valid & (F.col("delivery_days") <= sla)).cast("int")).alias("n_ontime"),
        F.sum(_late(sla).cast("int")).alias("n_late"),
        F.grouping_id().alias("_gid"))
    level = F.lit(None).cast("string")
    for name in _SETS:
        level = F.when(F.col("_gid") == _gid(name), F.lit(name)).otherwise(level)
    return g.withColumn("level", level).drop("_gid")


def monthly_kpis(shipments: DataFrame, sla: int = SLA_DAYS, facts: DataFrame | None = None) -> DataFrame:
    """Per (client, month): shipments, avgdelivery, ontimedelivery."""
    f = (facts if facts is not None else report_facts(shipments, sla)).where(F.col("level") == "month")
    return f.select(
        "client", "month", F.col("n").alias("shipments"),
        F.round(F.try_divide(F.col("sum_days").cast("double"), F.col("n_valid")), 1).alias("avgdelivery"),
        F.round(F.try_divide(F.col("n_ontime").cast("double"), F.col("n_valid")) * 100).cast("bigint")
        .alias("ontimedelivery"))


def percent_change(df: DataFrame, key: str, period: str, value: str, out: str = "percent_change",
                   months: int = 1) -> DataFrame:
    """WIN4: change of ``value`` against the previous calendar period.

    The previous period is looked up by an equi join on (key, period - 1
    month), which is exactly a gap-free spine: a missing month gives null,
    never the month before it.  ``df`` is expected to be aggregated already.
    """
    prev = df.select(
        F.col(key).alias("_pk"),
        F.add_months(F.col(period), months).alias("_pp"),
        F.col(value).alias("_prev"),
    )
    j = df.join(prev, df[key].eqNullSafe(prev["_pk"]) & (df[period] == prev["_pp"]), "left")
    pct = F.when(F.col("_prev").isNull() | (F.col("_prev") == 0), F.lit(None)).otherwise(
        F.round(100.0 * (F.col(value) - F.col("_prev")) / F.col("_prev")))
    return j.select(*[df[c] for c in df.columns], pct.cast("bigint").alias(out))


def delay_reasons(shipments: DataFrame, n: int = 3, sla: int = SLA_DAYS, facts: DataFrame | None = None) -> DataFrame:
    """KPI2: up to n reasons of late rows per (client, month), count desc, reason asc."""
    if facts is None:
        month = F.trunc(F.col("shipped_at").cast("date"), "MM").alias("month")
        counts = shipments.where(_late(sla)).groupBy("client", month, "reason").agg(F.count(F.lit(1)).alias("late_count"))
    else:
        counts = facts.where((F.col("level") == "reason") & (F.col("n_late") > 0)).select(
            "client", "month", "reason", F.col("n_late").alias("late_count"))
    w = Window.partitionBy("client", "month").orderBy(F.desc("late_count"), F.asc("reason"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def suggest(shipments: DataFrame, min_support: int = 5, sla: int = SLA_DAYS, facts: DataFrame | None = None) -> DataFrame:
    """KPI3: per client, the route and the carrier with the highest late rate.

    Late rate = late rows / rows with a valid delivery time; only candidates
    with at least ``min_support`` valid rows; ties go to the smaller name.
    The rates come from the shared facts, so no extra pass over shipments.
    """
    if facts is None:  # read by three branches: aggregate once, keep it in the shared checkpoint folder
        ensure_checkpoint_dir(shipments.sparkSession)
        facts = report_facts(shipments, sla).transform(lambda d: materialize(d, "report-facts"))
    f = facts

    def worst(dim: str) -> DataFrame:
        rates = f.where((F.col("level") == dim) & (F.col("n_valid") >= min_support)).select(
            "client", dim, (F.col("n_late") / F.col("n_valid")).alias("rate"))
        w = Window.partitionBy("client").orderBy(F.desc("rate"), F.asc(dim))
        return (rates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
                .select("client", dim, F.round("rate", 4).alias(f"{dim}_late_rate")))

    clients = f.where(F.col("level") == "month").select("client").distinct()
    return join_on(join_on(clients, worst("route"), ["client"], "left"), worst("carrier"), ["client"], "left")


def monthly_report(shipments: DataFrame, sla: int = SLA_DAYS, min_support: int = 5) -> DataFrame:
    """KPI1: the report row per client and month, from one pass of facts.

    The facts are read by three branches; Catalyst prunes each branch's
    aggregate differently, so they would not share a shuffle and the join
    would run three times.  The small aggregated facts are therefore
    checkpointed once (reliable checkpoint in the shared folder, which also
    cuts the lineage back to the raw tables).
    """
    ensure_checkpoint_dir(shipments.sparkSession)
    facts = report_facts(shipments, sla).transform(lambda d: materialize(d, "report-facts"))
    base = percent_change(monthly_kpis(shipments, sla, facts), "client", "month", "shipments")
    reasons = delay_reasons(shipments, 3, sla, facts).groupBy("client", "month").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "reason"))), lambda s: s["reason"]),
            ", ").alias("delayreasons"))
    sugg = suggest(shipments, min_support, sla, facts).select(
        "client", F.concat_ws(", ", "route", "carrier").alias("suggested"))
    sugg = sugg.withColumn("suggested", F.when(F.col("suggested") == "", None).otherwise(F.col("suggested")))
    return (join_on(join_on(base, reasons, ["client", "month"], "left"), sugg, ["client"], "left")
            .select(F.col("client").alias("client_name"), "month", "shipments", "avgdelivery",
                    "percent_change", "ontimedelivery", "delayreasons", "suggested"))


def net_payments(payments: DataFrame) -> DataFrame:
    """KPI4: payments minus refunds per day, cents to currency (decimal)."""
    cents = F.col("amount_cents")
    return payments.groupBy(F.to_date("ts").alias("day")).agg(
        F.sum(F.when(F.col("type") == "checkout.session.completed", cents).otherwise(0)).alias("paid_cents"),
        F.sum(F.when(F.col("type") == "charge.refunded", cents).otherwise(0)).alias("refunded_cents"),
    ).select(
        "day",
        (F.col("paid_cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("paid"),
        (F.col("refunded_cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("refunded"),
        ((F.col("paid_cents") - F.col("refunded_cents")).cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("net"),
    )


def call_queue(calls: DataFrame, clients: DataFrame, as_of: dt.datetime) -> DataFrame:
    """KPI5: open calls joined to their client, age in days, oldest first.

    ``calls``: call_id, client_id, date_requested, called.
    ``clients``: client_id, company, phone.
    """
    open_calls = calls.where(~F.col("called"))
    return (open_calls.join(clients, "client_id")
            .select("call_id", "client_id", "company", "phone", "date_requested",
                    F.datediff(F.lit(as_of.date()), F.col("date_requested").cast("date")).alias("age_days"))
            .orderBy("date_requested", "call_id"))


def visitors(events: DataFrame) -> DataFrame:
    """KPI6: total and returning visitors per weekday.

    A visitor is returning on a day when it was first seen on an earlier
    day.  First-seen is an aggregate per user joined back, not a window, so
    a user with a third of all events is still combined map-side.
    """
    day = F.to_date("ts")
    daily = events.select("user_id", day.alias("day")).distinct()
    first = events.groupBy("user_id").agg(F.min(day).alias("first_day"))
    d = join_on(daily, first, ["user_id"])
    return d.groupBy(F.dayofweek("day").alias("weekday")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("day") > F.col("first_day")).cast("int")).alias("returning"),
    )


def period_compare(events: DataFrame, as_of: dt.date, slot_hours: int = 4) -> DataFrame:
    """KPI7: today vs the previous day in fixed hour slots (count and value)."""
    day = F.to_date("ts")
    today, yesterday = F.lit(as_of), F.date_sub(F.lit(as_of), 1)
    e = events.where(day.between(yesterday, today)).select(
        (F.floor(F.hour("ts") / slot_hours) * slot_hours).cast("int").alias("slot_start"),
        (day == today).alias("is_today"), "value")
    return e.groupBy("slot_start").agg(
        F.sum(F.col("is_today").cast("int")).alias("today_count"),
        F.sum((~F.col("is_today")).cast("int")).alias("previous_count"),
        F.round(F.sum(F.when(F.col("is_today"), F.col("value")).otherwise(0.0)), 2).alias("today_value"),
        F.round(F.sum(F.when(~F.col("is_today"), F.col("value")).otherwise(0.0)), 2).alias("previous_value"),
    )
