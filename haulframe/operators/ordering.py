"""ORD1-ORD4, PAG1-PAG3, TOP1, WIN1, WIN2, WIN5, WIN6: order-dependent operators.

Sorting is Spark's range-partitioned sort; positions come from
``positions.global_row_number`` (no single-task window); per-key ordered
scans go through ``segmented`` so a hot key is split by a coarse bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.operators import segmented
from haulframe.operators.nullsafe import join_on
from haulframe.operators.pages import Order, page_rows, sort_columns
from haulframe.operators.positions import global_row_number

# ---------------------------------------------------------------------------
# ORD1: type-aware sort keys


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number_of(text: Column) -> Column:
    """The value of a text that reads as a finite decimal number, else null.

    Only what looks like a number is cast: a failing cast costs an exception
    per row, and a plain cast also takes ``3f``, ``7d`` or ``NaN``.
    """
    trimmed = F.trim(text)
    value = F.when(trimmed.rlike(NUMBER), trimmed).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def smart_sort_keys(c: Column, descending: bool = False, empty_last: bool = False) -> list[Column]:
    """Total order for a column compared the way a table widget compares cells.

    Null counts as the empty string.  Empty cells come first (they are the
    smallest text) unless ``empty_last``; then numeric-looking cells by
    value; then the remaining text.  A pairwise JS comparison is not
    transitive on mixed columns, so this fixed order (numbers before text)
    stands in for it.
    """
    text = F.coalesce(c.cast("string"), F.lit(""))
    filled, number = text != "", number_of(text)
    keys = [k.desc() if descending else k.asc() for k in (number.isNull(), number, text)]
    return [filled.desc() if descending or empty_last else filled.asc(), *keys]


def sort_smart(df: DataFrame, col: str, tiebreak: list[str], descending: bool = False,
               empty_last: bool = False, out: str = "position") -> DataFrame:
    """ORD1: rows numbered in type-aware order; ``tiebreak`` keeps equal keys in input order."""
    order = smart_sort_keys(F.col(col), descending, empty_last) + [F.col(c).asc() for c in tiebreak]
    return global_row_number(df, order, out)


def sort_multi(df: DataFrame, spec: list[tuple[str, str]], tiebreak: list[str], fold_case: bool = False,
               out: str = "position") -> DataFrame:
    """ORD2: multi-column sort, a direction per column, optional case folding of text.

    Text columns have the order of ``smart_sort_keys``: empty cells, then
    numbers by value, then other text.
    """
    order = []
    types = dict(df.dtypes)
    for c, d in spec:
        if types[c] == "string":
            order += smart_sort_keys(F.lower(c) if fold_case else F.col(c), d == "desc")
        else:
            order.append(F.col(c).desc() if d == "desc" else F.col(c).asc())
    order += [F.col(c).asc() for c in tiebreak]
    return global_row_number(df, order, out)


def order_groups(df: DataFrame, group: str, order: str | list[str], member_order: list[str],
                 out: str = "position") -> DataFrame:
    """ORD3: groups asc, desc or in an explicit list (unlisted groups dropped); members ordered inside."""
    if isinstance(order, list):
        rank = F.array_position(F.array(*[F.lit(g) for g in order]), F.col(group))
        d = df.where(F.col(group).isin(order))
        keys = [rank.asc()]
    else:
        d = df
        keys = [F.col(group).desc() if order == "desc" else F.col(group).asc()]
    return global_row_number(d, keys + [F.col(c).asc() for c in member_order], out)


def natural_key(c: Column) -> Column:
    """ORD4: natural sort key: an array with one entry per run of digits or of other characters.

    A digit run sorts by the number of its significant digits and then by
    them, so it may have any length; other runs sort as lower-case text,
    after digits.
    """
    def entry(run: Column) -> Column:
        number = run.rlike("^[0-9]+$")
        significant = F.when(number, F.regexp_replace(run, "^0+(?=[0-9])", ""))
        return F.struct((~number).alias("text"), F.length(significant).alias("size"), significant.alias("digits"),
                        F.when(~number, F.lower(run)).alias("letters"))

    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+|[^0-9]+)"), 1), entry)


def sort_natural(df: DataFrame, cols: str | list[str], tiebreak: list[str], out: str = "position") -> DataFrame:
    """ORD4: rows numbered in the natural order of one or more columns."""
    keys = [natural_key(F.col(c)).asc() for c in ([cols] if isinstance(cols, str) else cols)]
    return global_row_number(df, keys + [F.col(c).asc() for c in tiebreak], out)


# ---------------------------------------------------------------------------
# PAG1-PAG3, TOP1


def page(df: DataFrame, order: Order | list[Column], number: int, size: int, where: Column | None = None) -> DataFrame:
    """PAG1: page ``number`` (1-based, clamped to the last page) of ``size`` rows.

    Adds total (after ``where``), total_unfiltered, from_row and to_row.
    The table is not sorted for it (see ``pages``), however deep the page
    is.  ``order`` must be total; besides names it may hold expressions.
    """
    made = {f"_order{i}": o for i, o in enumerate(order) if isinstance(o, Column)}
    if made:
        named = [f"_order{i}" if isinstance(o, Column) else o for i, o in enumerate(order)]
        return page(df.withColumns(made), named, number, size, where).drop(*made)
    filtered = df.where(where) if where is not None else df
    total = filtered.count()
    total_unfiltered = df.count() if where is not None else total
    last = max(1, math.ceil(total / size))
    n = min(max(number, 1), last)
    start = (n - 1) * size
    rows = page_rows(filtered, order, start, size, total)
    return rows.select("*", F.lit(total).alias("total"), F.lit(total_unfiltered).alias("total_unfiltered"),
                       F.lit(start + 1 if total else 0).alias("from_row"), F.lit(min(start + size, total)).alias("to_row"),
                       F.lit(n).alias("page_number"))


def table_request(df: DataFrame, request: dict, tiebreak: list[str]) -> DataFrame:
    """PAG2: draw/start/length request with a global search, column searches and order.

    request = {"draw": int, "start": int, "length": int,
               "search": {"value": str, "columns": [..]},
               "columns": {col: search text}, "order": [(col, "asc"|"desc")]}
    """
    from haulframe.operators.filters import advanced_search, smart_search

    d = df
    s = request.get("search") or {}
    if s.get("value"):
        d = smart_search(d, s["value"], s.get("columns") or d.columns)
    if request.get("columns"):
        d = advanced_search(d, request["columns"])
    total = df.count()
    filtered = total if d is df else d.count()
    order = [*request.get("order", []), *tiebreak]
    start, length = request.get("start", 0), request.get("length", 10)
    if length < 0 and start <= 0:  # -1 asks for all rows
        rows = d.orderBy(*sort_columns(order))
    else:
        rows = page_rows(d, order, start, length if length >= 0 else filtered, filtered)
    return rows.select("*", F.lit(request.get("draw", 1)).alias("draw"), F.lit(total).alias("records_total"),
                       F.lit(filtered).alias("records_filtered"))


def page_windows(df: DataFrame, order: list[Column], window: int, size: int, out: str = "window_id") -> DataFrame:
    """PAG3: prefetch windows: the window is rounded up to a multiple of the page size."""
    w = math.ceil(window / size) * size
    pos = global_row_number(df, order, "position")
    return pos.withColumn(out, F.floor((F.col("position") - 1) / w).cast("bigint")).withColumn(
        "page_in_window", (F.floor((F.col("position") - 1 - F.col(out) * w) / size) + 1).cast("bigint"))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """TOP1: first k rows in order (TakeOrderedAndProject: a bounded heap per task)."""
    return df.orderBy(*order).limit(k)


# ---------------------------------------------------------------------------
# WIN1, WIN2, WIN5, WIN6


def run_groups(df: DataFrame, part: list[str], bucket: Column, order: list, cols: list[str],
               empty: str = "", prefix: str = "group") -> DataFrame:
    """WIN1: number contiguous runs of equal values per level, within ``part``.

    Level k breaks when any of cols[0..k] changes (nested groups); null is
    the ``empty`` label; a value that returns later opens a new run.  The
    scan is segmented by ``bucket`` (see ``segmented``).
    """
    d = df
    for i in range(len(cols)):
        label = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit(empty)) for c in cols[: i + 1]])
        d = d.withColumn(f"_lab{i}", label)
    # one scan for every level's previous label, one for every level's running change count
    d = segmented.scan(d, part, bucket, order, [segmented.Spec("lag", f"_lab{i}", f"_prev{i}") for i in range(len(cols))])
    for i in range(len(cols)):
        d = d.withColumn(f"_chg{i}", (~F.col(f"_lab{i}").eqNullSafe(F.col(f"_prev{i}"))).cast("int"))
    d = segmented.scan(d, part, bucket, order,
                       [segmented.Spec("sum", f"_chg{i}", f"{prefix}_{i + 1}") for i in range(len(cols))])
    return d.drop(*[f"_{k}{i}" for i in range(len(cols)) for k in ("lab", "prev", "chg")])


def top_per_group(df: DataFrame, group: str, order: list[str], per_group: int, overall: int | None) -> DataFrame:
    """WIN2: at most ``per_group`` rows per group in arrival order, then an overall cap.

    Groups are listed in order of their first arrival; the cap cuts that
    listing (3 + 3 + 2 for a cap of 8 over groups of 4).
    """
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("group_rank", F.row_number().over(w)).where(F.col("group_rank") <= per_group)
    first = df.groupBy(group).agg(F.min(F.struct(*order)).alias("_first"))
    listed = join_on(ranked, first, [group])
    listing = [F.col("_first").asc(), F.col("group_rank").asc()]
    out = listed.orderBy(*listing)
    if overall is not None:
        out = out.limit(overall)
    return out.drop("_first")


def min_step(df: DataFrame, series: str, x: str, bucket: Column, order_tiebreak: list[str],
             default: float = 0.5) -> DataFrame:
    """WIN5: smallest positive step between neighbouring x values per series (default when none)."""
    d = segmented.prev_value(df.select(series, x, *order_tiebreak), [series], bucket, [x, *order_tiebreak],
                             x, "_px")
    steps = d.select(series, (F.col(x) - F.col("_px")).alias("_step"))
    mins = steps.groupBy(series).agg(F.min(F.when(F.col("_step") > 0, F.col("_step"))).alias("min_step"))
    return mins.select(series, F.coalesce(F.col("min_step").cast("double"), F.lit(default)).alias("min_step"))


def with_position(df: DataFrame, keys: list[str], input_order: str, out: str = "position") -> DataFrame:
    """WIN6: position by ``keys``; equal keys keep input order (unique ``input_order``)."""
    return global_row_number(df, [F.col(k).asc() for k in keys] + [F.col(input_order).asc()], out)
