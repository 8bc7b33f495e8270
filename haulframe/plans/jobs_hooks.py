"""Registered jobs: UDF1-UDF6 (hooks applied to the given tables)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from haulframe.functions import hooks
from haulframe.plans.registry import job


def _ring_and_big(name: pd.Series, size: pd.Series) -> pd.Series:
    return name.str.contains("ring", regex=False) & (size > 10)


@job("udf1_row_predicate", "SELECT * FROM part WHERE contains(p_name, 'ring') AND p_size > 10")
def udf1_row_predicate(t):
    """UDF1: vectorised pandas predicate (Arrow batches) as a row filter."""
    pred = hooks.pandas_predicate(_ring_and_big)
    return hooks.apply_predicate(t.part, pred(F.col("p_name"), F.col("p_size")))


@job("udf1_column_predicate", "SELECT * FROM part WHERE p_retailprice > 1000 AND p_type <> 'SMALL'")
def udf1_column_predicate(t):
    """UDF1: predicate hook written as a Column (stays in Catalyst and is pushed to the scan)."""
    return hooks.apply_predicate(t.part, lambda d: (d.p_retailprice > 1000) & (d.p_type != "SMALL"))


@job("udf2_sort_key", """
SELECT p_partkey, p_name, row_number() OVER (ORDER BY length(p_name) DESC, p_partkey) AS position FROM part
""")
def udf2_sort_key(t):
    """UDF2: custom sort key (name length, longest first) with positions."""
    p = t.part.select("p_partkey", "p_name")
    return hooks.sort_by_key(p, lambda d: F.length(d.p_name), ["p_partkey"], descending=True)


@job("udf3_formatter", """
SELECT n_nationkey, upper(n_name) AS n_name, 'R-' || CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation
""")
def udf3_formatter(t):
    """UDF3: cell formatters as Column functions."""
    return hooks.format_cells(t.nation, {"n_name": F.upper,
                                         "n_regionkey": lambda c: F.concat(F.lit("R-"), c.cast("string"))})


@job("udf4_aggregate_hook", """
SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1
""")
def udf4_aggregate_hook(t):
    """UDF4: footer / group aggregate hooks as aggregate Columns."""
    return hooks.aggregate_hook(t.lineitem, ["l_returnflag"], {
        "revenue": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2),
        "orders": F.count_distinct("l_orderkey")})


@job("udf4_pandas_aggregate", """
SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 2) AS spread, count(*) AS n FROM orders GROUP BY 1
""")
def udf4_pandas_aggregate(t):
    """UDF4: a group aggregate hook in pandas (price spread per priority), merged from the parts of each batch."""
    o = t.orders.select("o_orderpriority", "o_totalprice")
    return hooks.pandas_partial_aggregate(
        o, ["o_orderpriority"], lambda g: {"hi": g.o_totalprice.max(), "lo": g.o_totalprice.min(), "n": len(g)},
        "hi double, lo double, n long",
        {"spread": F.round(F.max("hi") - F.min("lo"), 2), "n": F.sum("n")})


def _line_shares(pdf: pd.DataFrame) -> pd.DataFrame:
    """Share of each line in its order's price; ``pdf`` holds whole orders."""
    out = pdf[["l_orderkey", "l_linenumber", "l_extendedprice"]].copy()
    total = out.groupby("l_orderkey", dropna=False)["l_extendedprice"].transform("sum")
    out["share"] = (out["l_extendedprice"] / total).where(total != 0, 0.0).round(6)
    return out


@job("udf5_group_transform", """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share
FROM lineitem
""")
def udf5_group_transform(t):
    """UDF5: whole-group pandas transform per order (share of each line in its order)."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return hooks.group_transform(li, ["l_orderkey"], _line_shares,
                                 "l_orderkey long, l_linenumber int, l_extendedprice double, share double",
                                 vectorized=True)


@job("udf6_normalize", """
WITH m AS (SELECT min(sqrt(o_totalprice)) AS lo, max(sqrt(o_totalprice)) AS hi FROM orders)
SELECT o_orderkey, round(CASE WHEN hi = lo THEN 0.0 ELSE (sqrt(o_totalprice) - lo) / (hi - lo) END, 8) AS scaled
FROM orders, m
""")
def udf6_normalize(t):
    """UDF6: custom normalisation function (square root) before min-max scaling."""
    r = hooks.normalize(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", F.sqrt, "scaled")
    return r.select("o_orderkey", F.round("scaled", 8).alias("scaled"))
