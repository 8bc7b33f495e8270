"""JOIN1-JOIN10: lookups, grants, series alignment, interval overlap, trees, recurrences.

Equi joins are left to Catalyst (AQE turns a side that is small at runtime
into a broadcast and splits skewed partitions); explicit broadcasts are
only used for tables whose size is checked.  Fan-outs over a parameter-like
table (permissions, newsletter ids) are joins on chunks of its values
instead of a cartesian product.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.operators import segmented
from haulframe.operators.filters import first_per_key
from haulframe.operators.nullsafe import join_on
from haulframe.operators.positions import global_row_number
from haulframe.session import materialize

# Values of a fan-out list that travel together as one array.
FANOUT_CHUNK = 10_000


def resolve_client(submissions: DataFrame, users: DataFrame, clients: DataFrame) -> DataFrame:
    """JOIN1: submission -> user (by lower-cased e-mail) -> client of that user;
    without a user, client by e-mail; otherwise a new client.

    submissions: arrival, email_nm; users: user_id, email; clients: client_id, user_id, email.
    Each right side is reduced to its first row per key before the join,
    so a key repeated on the right cannot multiply submissions.
    branch: client_of_user | update_or_create | client_by_email | create.
    """
    s = submissions.withColumn("email", F.lower("email_nm"))
    u = first_per_key(users.select("user_id", "email"), "email", "user_id")
    cu = first_per_key(clients.where(F.col("user_id").isNotNull()).select("user_id", "client_id"),
                       "user_id", "client_id").withColumnRenamed("client_id", "_cu")
    ce = first_per_key(clients.select("email", "client_id"), "email", "client_id").withColumnRenamed(
        "client_id", "_ce")
    j = s.join(u, "email", "left").join(cu, "user_id", "left").join(ce, "email", "left")
    branch = (F.when(F.col("user_id").isNotNull() & F.col("_cu").isNotNull(), "client_of_user")
              .when(F.col("user_id").isNotNull(), "update_or_create")
              .when(F.col("_ce").isNotNull(), "client_by_email").otherwise("create"))
    client = F.when(branch == "client_of_user", F.col("_cu")).otherwise(F.col("_ce"))
    return j.select(*submissions.columns, "email", "user_id", client.alias("client_id"), branch.alias("branch"))


def semi(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """JOIN2: rows of df with a match in members (membership test)."""
    return df.join(members, on, "left_semi")


def _fanout(df: DataFrame, small: DataFrame, value: str, out: str) -> DataFrame:
    """One row per (row of df, value of small), as an equi join on chunks of the list.

    The values are dealt into arrays of about FANOUT_CHUNK; each row of df
    meets each array once (a join on the chunk's number) and explodes it.
    The same plan serves a list of any length, with one pass over df.
    """
    chunks = max(1, math.ceil(small.count() / FANOUT_CHUNK))
    lists = (small.groupBy(F.pmod(F.xxhash64(value), F.lit(chunks)).cast("int").alias("_chunk"))
             .agg(F.collect_list(value).alias("_values")))
    rows = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return rows.join(lists, "_chunk").select(*df.columns, F.explode("_values").alias(out))


def base_grants(users: DataFrame) -> DataFrame:
    """Per user: 'access_<type>_pages' and the group '<Type>s'."""
    access = F.struct(F.lit("permission").alias("kind"),
                      F.concat(F.lit("access_"), F.col("user_type"), F.lit("_pages")).alias("grant"))
    group = F.struct(F.lit("group").alias("kind"), F.initcap(F.concat(F.col("user_type"), F.lit("s"))).alias("grant"))
    return users.select("user_id", F.explode(F.array(access, group)).alias("_g")).select("user_id", "_g.kind", "_g.grant")


def expand_grants(users: DataFrame, perms: DataFrame) -> DataFrame:
    """JOIN4: sign-up fan-out.

    users: user_id, user_type (admin | member); perms: codename.
    Admins get every permission whose codename starts with 'manage'; every
    user gets 'access_<type>_pages' and the group '<Type>s'.
    """
    manage = perms.where(F.col("codename").startswith("manage")).select("codename").distinct()
    admins = users.where(F.col("user_type") == "admin").select("user_id", F.lit("permission").alias("kind"))
    return _fanout(admins, manage, "codename", "grant").unionByName(base_grants(users))


def audience(newsletters: DataFrame, subscribers: DataFrame) -> DataFrame:
    """JOIN5: each undispatched newsletter to each subscriber not removed.

    newsletters: newsletter_id, dispatched; subscribers: email, removed.
    The newsletter queue is the small side; its ids are fanned out per
    subscriber in chunks (see ``_fanout``).
    """
    queue = newsletters.where(~F.col("dispatched")).select("newsletter_id")
    subs = subscribers.where(~F.col("removed")).select("email")
    return _fanout(subs, queue, "newsletter_id", "newsletter_id")


def align_series(df: DataFrame, series: str, x: str, y: str, names: list[str] | None = None, order: str | None = None) -> DataFrame:
    """JOIN6: one row per x of any series, sorted by x, one column per series, null where a series has no point.

    Equals an n-way full outer join on x.  The series are those of the data
    (Spark finds them in one small job); with ``names`` only those are kept.
    Of several points of a series at one x the last by ``order`` counts
    (without one, the largest y).
    """
    return df.groupBy(x).pivot(series, names).agg(F.max_by(y, order) if order else F.max(y)).orderBy(x)


def overlaps(df: DataFrame, key: str, start: str, end: str, id_col: str, bucket: Column) -> DataFrame:
    """JOIN7: flag every closed interval that overlaps another interval of the same key.

    In (start, id) order an interval overlaps an earlier one iff the running
    max of earlier ends reaches its start, and a later one iff the next start
    is within its end.  Both scans are segmented by ``bucket`` (a coarse
    function of start), so no pair is ever emitted and a hot key is split.
    """
    order = [start, id_col]
    d = segmented.scan(df, [key], bucket, order, [
        segmented.Spec("max", end, "_prev_max_end", inclusive=False),
        segmented.Spec("lead", start, "_next_start")])
    flag = F.coalesce(F.col("_prev_max_end") >= F.col(start), F.lit(False)) | F.coalesce(
        F.col("_next_start") <= F.col(end), F.lit(False))
    return d.withColumn("overlaps", flag).drop("_prev_max_end", "_next_start")


def _ancestry(edges: DataFrame, root: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, rows that reach a root, rows that close a cycle): id, pid and the trail of ids from the root.

    Pointer doubling: every row knows an ancestor and the trail down from
    it; joining a row with its ancestor's row doubles the trail, so a tree
    of depth d takes log2(d) rounds.  A trail that holds an id twice runs
    into a cycle and is set aside; a row whose ancestors end in an unknown
    parent drops out.  Each round is written, which cuts the lineage.
    """
    e = materialize(edges.select(F.col("id").cast("string").alias("id"), F.col("pid").cast("string").alias("pid")),
                    "tree-edges")
    is_root = (F.col("pid").isNull() | (F.col("pid") == "") | (F.col("pid") == "0")) if root is None \
        else F.coalesce(F.col("id") == root, F.lit(False))
    rows = materialize(e.select("id", "pid", F.when(~is_root, F.col("pid")).alias("up"), F.array("id").alias("trail"),
                                is_root.alias("done")), "tree-rows")
    cycles = rows.select("id", "pid", "trail").limit(0)
    while not rows.where(~F.col("done")).isEmpty():
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("trail").alias("_trail"),
                            F.col("done").alias("_done"))
        step = rows.where(~F.col("done")).join(above, "up").select(
            "id", "pid", F.col("_up").alias("up"), F.concat("_trail", "trail").alias("trail"), F.col("_done").alias("done"))
        step = step.withColumn("_twice", F.size(F.array_distinct("trail")) < F.size("trail"))
        step = materialize(step, "tree-step")
        cycles = cycles.unionByName(step.where("_twice").select("id", "pid", "trail"))
        rows = materialize(rows.where("done").unionByName(step.where("NOT _twice").drop("_twice")), "tree-rows")
    return e, rows.select("id", "pid", "trail"), cycles


def tree_cycles(edges: DataFrame, root: str | None = None) -> DataFrame:
    """JOIN8: id, pid of the rows that never reach a root because their ancestors form a cycle."""
    return _ancestry(edges, root)[2].select("id", "pid").distinct()


def tree(spark: SparkSession, edges: DataFrame, root: str | None = None) -> DataFrame:
    """JOIN8: adjacency list (id, pid) -> id, pid, level, path, child_count, sibling_no.

    Roots are rows whose parent is null, empty or '0', or the given root id;
    trees of any depth are followed (see ``_ancestry``), and rows in or
    below a cycle are left out and reported by ``tree_cycles``.
    """
    e, reached, _ = _ancestry(edges, root)
    levels_df = reached.select("id", "pid", F.size("trail").alias("level"), F.array_join("trail", "/").alias("path"))
    children = e.where(F.col("pid").isNotNull()).groupBy(F.col("pid").alias("id")).agg(
        F.count(F.lit(1)).alias("child_count"))
    # sibling number = position in (pid, id) order minus the parent's first position
    # (no per-parent window: a parent with a third of all nodes stays spread out)
    pos = global_row_number(levels_df, [F.col("pid").asc_nulls_first(), F.col("id").asc()], "_pos")
    first = pos.groupBy("pid").agg(F.min("_pos").alias("_first"))
    return (join_on(pos, first, ["pid"])
            .join(children, "id", "left")
            .withColumn("child_count", F.coalesce("child_count", F.lit(0)))
            .withColumn("sibling_no", F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first"))


def expand_recurrence(rules: DataFrame, lo: dt.date, hi: dt.date) -> DataFrame:
    """JOIN9: weekly rules -> instances inside [lo, hi).

    rules: rule_id, days_of_week (array, 0 = Sunday; null means every day),
    start_time / end_time (seconds after midnight; a null start is
    midnight, a null end leaves the instance open), start_recur (inclusive),
    end_recur (exclusive; null bounds do not bound).
    Each rule expands only over its clipped date range, a bounded generator.
    """
    first = F.greatest(F.col("start_recur"), F.lit(lo))
    last = F.least(F.col("end_recur"), F.lit(hi))
    r = rules.where(first < last).withColumn(
        "day", F.explode(F.sequence(first, F.date_sub(last, 1), F.expr("INTERVAL 1 DAY"))))
    r = r.where(F.col("days_of_week").isNull() | F.array_contains(F.col("days_of_week"), F.dayofweek("day") - 1))
    base = F.col("day").cast("timestamp_ntz")
    return r.select("rule_id", "day",
                    F.timestamp_add("SECOND", F.coalesce(F.col("start_time"), F.lit(0)), base).alias("instance_start"),
                    F.timestamp_add("SECOND", F.col("end_time"), base).alias("instance_end"))


def attach_values(regions: DataFrame, values: DataFrame, on: str) -> DataFrame:
    """JOIN10: values attached to known regions only; unknown codes are ignored."""
    return regions.join(values, on, "inner")
