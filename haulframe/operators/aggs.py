"""AGG1-AGG15: chart and table aggregates.

Everything is a hash aggregate with map-side partial combine; windows only
run over aggregated tables; grand totals are scalar subqueries (a one-row
result Catalyst evaluates once).  Exact quantiles are computed by position
in a range-partitioned sort instead of collecting a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.operators.nullsafe import join_on
from haulframe.operators.positions import global_row_number, global_running_sum
from haulframe.operators.totals import with_totals


def series_totals(df: DataFrame, series: str = "series", y: str = "y") -> DataFrame:
    """AGG1: total per series."""
    return df.groupBy(series).agg(F.sum(y).alias("total"))


def stacked_totals(df: DataFrame, x: str = "x", y: str = "y", series: str = "series",
                   exclude: list[str] | None = None) -> DataFrame:
    """AGG2: stacked total per x over all series not excluded."""
    d = df.where(~F.col(series).isin(exclude)) if exclude else df
    return d.groupBy(x).agg(F.sum(y).alias("stacked_total"))


def stacked_totals_by_group(df: DataFrame, groups: dict[str, str], x: str = "x", y: str = "y",
                            series: str = "series") -> DataFrame:
    """AGG3: stacked totals per declared series group (series outside every group are left out)."""
    m = F.create_map(*[F.lit(v) for kv in groups.items() for v in kv])
    d = df.withColumn("stack_group", m[F.col(series)]).where(F.col("stack_group").isNotNull())
    return d.groupBy("stack_group", x).agg(F.sum(y).alias("stacked_total"))


def percent_share(df: DataFrame, x: str, y: str, series: str) -> DataFrame:
    """AGG4: percent of each series within its x (100 % stacked) and of the grand total (pie).

    A zero total gives 0 in the stacked case, null for the pie.
    """
    per_x = df.groupBy(x).agg(F.sum(y).alias("_xt"))
    d = with_totals(join_on(df, per_x, [x]), {"_grand": F.sum(y)}, source=df)
    grand = F.col("_grand")
    return d.select(
        x, series, y,
        F.when(F.col("_xt") == 0, F.lit(0.0)).otherwise(100.0 * F.col(y) / F.col("_xt")).alias("share_of_x"),
        F.when(grand == 0, F.lit(None)).otherwise(100.0 * F.col(y) / grand).alias("share_of_total"),
    )


def totals_in_range(df: DataFrame, lo, hi, x: str = "x", y: str = "y", series: str = "series") -> DataFrame:
    """AGG5: total per series over lo < x < hi (open interval)."""
    return df.where((F.col(x) > F.lit(lo)) & (F.col(x) < F.lit(hi))).groupBy(series).agg(F.sum(y).alias("total"))


def value_range(df: DataFrame, series: str, low: str, high: str | None = None) -> DataFrame:
    """AGG6: min of ``low`` and max of ``high`` per series and overall (series null); nulls skipped."""
    return df.rollup(series).agg(F.min(low).alias("min_value"), F.max(high or low).alias("max_value"))


def stacked_pos_neg(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """AGG7: positive and negative stack sums per group and x."""
    return df.groupBy(group, x).agg(
        F.sum(F.greatest(F.col(y), F.lit(0.0))).alias("positive"),
        F.sum(F.least(F.col(y), F.lit(0.0))).alias("negative"))


def group_rows(df: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """AGG8: rows grouped by ``cols``: each row gets its group id, group size and place in the group.

    Groups are numbered in key order from the table of distinct keys (no
    single-task window); members are not gathered into one array, so a
    group of any size stays spread over tasks.
    """
    # position in (group, order): no per-group window, so a group holding a third of the rows is still spread out
    pos = global_row_number(df, [F.col(c).asc() for c in cols] + [F.col(c).asc() for c in order], "_pos")
    groups = pos.groupBy(*cols).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("group_size"))
    # one row per group, numbered in key order
    groups = global_row_number(groups, [F.col("_start").asc()], "group_id")
    return (join_on(pos, groups, cols)
            .withColumn("member_no", F.col("_pos") - F.col("_start") + 1).drop("_pos", "_start"))


def distinct_options(df: DataFrame, col: str, first_by: str, case_insensitive: bool = True) -> DataFrame:
    """AGG9: distinct filter choices in order; arrays flattened; case-insensitive keys keep their first spelling."""
    dtype = dict(df.dtypes)[col]
    d = df.select(F.explode_outer(col).alias("option"), first_by) if dtype.startswith("array") else \
        df.select(F.col(col).alias("option"), first_by)
    d = d.where(F.col("option").isNotNull())
    key = F.lower(F.col("option")) if case_insensitive else F.col("option")
    return d.groupBy(key.alias("option_key")).agg(
        F.min_by("option", F.col(first_by)).alias("option")).orderBy("option_key")


def hit_counts(df: DataFrame, group: str) -> DataFrame:
    """AGG10: hits per group plus the overall total (group null), via rollup."""
    return df.rollup(group).agg(F.count(F.lit(1)).alias("hits"))


def footer(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """AGG11: one footer row of user aggregate expressions over the (filtered) rows."""
    return df.agg(*[e.alias(n) for n, e in aggs.items()])


def box_stats(df: DataFrame, by: str, col: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """AGG12: min, quartiles (linear interpolation, exact) and max per category.

    The raw rows are first counted per (category, value), a partial
    aggregate that takes away repeated values.  A running count over the
    distinct pairs (range-partitioned, no window per category) gives the
    ranks each value covers, and the values at the needed ranks are picked
    by one conditional aggregate.  No category is ever held together; a
    null category is a category.
    """
    pairs = df.where(F.col(col).isNotNull()).groupBy(by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = global_running_sum(pairs, [F.col(by).asc_nulls_first(), F.col("_v").asc()], "_c", "_run")
    stats = run.groupBy(by).agg(F.sum("_c").alias("_n"), F.min("_v").alias("min"), F.max("_v").alias("max"),
                                F.min(F.col("_run") - F.col("_c")).alias("_off"))
    d = join_on(run.select(by, "_v", "_run"), stats, [by])
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    picks, out = [], []
    for i, p in enumerate(probs):
        place = F.lit(p) * (F.col("_n") - 1)

        def at(rank: Column, i=i) -> Column:
            # the least value whose running count reaches the rank (from 0)
            return F.min(F.when(F.col("_run") >= F.col("_off") + rank + 1, F.col("_v")))

        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
        part = place - F.floor(place)
        out.append((F.col(f"_lo{i}") + part * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(names.get(p, f"p{int(p * 100)}")))
    return d.groupBy(by, "_n", "min", "max").agg(*picks).select(by, "min", *out, "max")


def ohlc(df: DataFrame, ts: str, value: str, bucket: str, tiebreak: str, by: list[str] | None = None) -> DataFrame:
    """AGG13: open/high/low/close per time bucket (first/last by (ts, tiebreak))."""
    order = F.struct(F.col(ts), F.col(tiebreak))
    b = F.window(F.col(ts), bucket).start.alias("bucket_start")
    return df.groupBy(*(by or []), b).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"),
        F.min(value).alias("low"), F.max_by(value, order).alias("close"),
        F.count(F.lit(1)).alias("n"))


def matrix(df: DataFrame, row: str, col: str, values: list, agg: Column) -> DataFrame:
    """AGG14: row x column matrix (heat map) with the column values fixed up front."""
    return df.groupBy(row).pivot(col, values).agg(agg)


def count_requests(base: DataFrame, requests: DataFrame, key: str, counter: str) -> DataFrame:
    """AGG15: add the number of requests per key to the stored counter.

    The reference reads, increments and writes one row per request (racy);
    here all requests of a batch are counted first and added once.
    """
    counts = requests.groupBy(key).agg(F.count(F.lit(1)).alias("_added"))
    return base.join(counts, key, "left").withColumn(
        counter, F.col(counter) + F.coalesce(F.col("_added"), F.lit(0))).drop("_added")
