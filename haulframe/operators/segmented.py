"""Ordered scans that stay parallel when one key holds a large share of rows.

A window ``partitionBy(key).orderBy(ts)`` sends every row of a key to one
task; with a key holding a third of the table that task is the job.  The
scans here split each key into ordered segments (a coarse bucket of the
order, e.g. the day), run the window per (key, segment), and carry the
values across segment borders from a small per-segment aggregate:

* ``lag`` / ``lead``: the previous / next row's value within the key;
* ``sum`` / ``max`` / ``min``: running aggregates (inclusive or not).

``scan`` computes any number of these in ONE window pass, ONE aggregate
(which reads the input, not the window output) and ONE join of the
per-segment carries, so the input is read twice whatever the number of
outputs.  The per-segment table has one row per (key, segment); its carry
windows run over aggregated data only.  The bucket must be monotone in the
order (bucket(a) < bucket(b) implies a sorts before b).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.operators.nullsafe import join_on

_SEG = "_seg"
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Spec:
    kind: str          # lag | lead | sum | max | min
    col: str
    out: str
    inclusive: bool = True  # running aggregates only


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def scan(df: DataFrame, part: list[str], bucket: Column, order: list, specs: list[Spec]) -> DataFrame:
    """Add one column per spec, computed in key order within ``part``."""
    d = df.withColumn(_SEG, bucket)
    w = Window.partitionBy(*part, _SEG).orderBy(*_cols(order))
    run_w = {True: w.rowsBetween(Window.unboundedPreceding, Window.currentRow),
             False: w.rowsBetween(Window.unboundedPreceding, -1)}
    order_key = F.struct(*_cols(order))

    within, seg_aggs, carries = [], [], []
    seg_w = Window.partitionBy(*part).orderBy(_SEG)
    for i, s in enumerate(specs):
        if s.kind == "lag":
            within.append(F.lag(s.col).over(w).alias(f"_w{i}"))
            seg_aggs.append(F.max_by(F.col(s.col), order_key).alias(f"_s{i}"))
            carries.append(F.lag(f"_s{i}").over(seg_w).alias(f"_c{i}"))
        elif s.kind == "lead":
            within.append(F.lead(s.col).over(w).alias(f"_w{i}"))
            seg_aggs.append(F.min_by(F.col(s.col), order_key).alias(f"_s{i}"))
            carries.append(F.lead(f"_s{i}").over(seg_w).alias(f"_c{i}"))
        else:
            agg = _AGG[s.kind]
            within.append(agg(s.col).over(run_w[s.inclusive]).alias(f"_w{i}"))
            seg_aggs.append(agg(s.col).alias(f"_s{i}"))
            carries.append(agg(f"_s{i}").over(seg_w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c{i}"))

    d = d.select("*", *within, (F.row_number().over(w) == 1).alias("_first"),
                 F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    seg = df.withColumn(_SEG, bucket).groupBy(*part, _SEG).agg(*seg_aggs)
    seg = seg.select(*part, _SEG, *carries)
    d = join_on(d, seg, [*part, _SEG], "left")

    outs = []
    for i, s in enumerate(specs):
        wv, cv = F.col(f"_w{i}"), F.col(f"_c{i}")
        if s.kind == "lag":
            v = F.when(F.col("_first"), cv).otherwise(wv)
        elif s.kind == "lead":
            v = F.when(F.col("_last"), cv).otherwise(wv)
        elif s.kind == "sum":
            v = F.when(wv.isNull() & cv.isNull(), F.lit(None)).otherwise(
                F.coalesce(wv, F.lit(0)) + F.coalesce(cv, F.lit(0)))
        elif s.kind == "max":
            v = F.greatest(wv, cv)
        else:
            v = F.least(wv, cv)
        outs.append(v.alias(s.out))
    tmp = [f"_{p}{i}" for i in range(len(specs)) for p in ("w", "c")] + ["_first", "_last", _SEG]
    return d.select("*", *outs).drop(*tmp)


def prev_value(df: DataFrame, part: list[str], bucket: Column, order: list, col: str, out: str) -> DataFrame:
    """``out`` = value of ``col`` on the previous row (by ``order``) within ``part``."""
    return scan(df, part, bucket, order, [Spec("lag", col, out)])


def next_value(df: DataFrame, part: list[str], bucket: Column, order: list, col: str, out: str) -> DataFrame:
    """``out`` = value of ``col`` on the next row (by ``order``) within ``part``."""
    return scan(df, part, bucket, order, [Spec("lead", col, out)])


def running(df: DataFrame, part: list[str], bucket: Column, order: list, col: str, out: str,
            fn: str = "sum", inclusive: bool = True) -> DataFrame:
    """``out`` = fn over the rows up to this one (``inclusive``) or before it, within ``part``."""
    return scan(df, part, bucket, order, [Spec(fn, col, out, inclusive)])
