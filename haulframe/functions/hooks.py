"""UDF1-UDF6: user hooks.

A hook is preferably a Python callable that returns a Column: it stays in
Catalyst (pushdown, codegen).  When a hook must run Python per value, it is
an Arrow-batched ``pandas_udf`` (never a row-at-a-time ``udf``).  Hooks
that need a whole group at once (UDF5, UDF4 without a merge) run through
``group_transform``, which holds one group in one task; a pandas aggregate
that can be merged from parts runs through ``pandas_partial_aggregate``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from haulframe.operators.positions import global_row_number


def apply_predicate(df: DataFrame, hook: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """UDF1: custom row predicate (a Column, a callable returning one, or a boolean pandas_udf column)."""
    return df.where(hook(df) if callable(hook) and not isinstance(hook, Column) else hook)


def pandas_predicate(fn: Callable[..., pd.Series]):
    """Wrap a vectorised pandas function of Series into a boolean pandas_udf."""
    return F.pandas_udf(fn, "boolean")


def sort_by_key(df: DataFrame, key: Callable[[DataFrame], Column], tiebreak: list[str], descending: bool = False,
                out: str = "position") -> DataFrame:
    """UDF2: rows numbered by a custom sort key.  A two-argument comparator has no scalable form; keys only."""
    k = key(df)
    return global_row_number(df, [k.desc() if descending else k.asc(), *[F.col(c).asc() for c in tiebreak]], out)


def format_cells(df: DataFrame, formatters: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """UDF3: cell formatters, one Column function per column."""
    return df.select(*[formatters[c](F.col(c)).alias(c) if c in formatters else F.col(c) for c in df.columns])


def aggregate_hook(df: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """UDF4: aggregate hooks as aggregate Columns (partial aggregation stays on)."""
    return df.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()])


def group_transform(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                    vectorized: bool = False) -> DataFrame:
    """UDF5: whole-group transform in pandas; null keys form a group of their own.

    Same result as ``groupBy().applyInPandas(fn)`` without an Arrow round
    trip per group: rows are hash-partitioned by the keys, sorted, and
    streamed in batches; the groups that end in a batch go to the hook
    together with the parts of the first one that earlier batches held.
    With ``vectorized`` the hook gets a frame of several whole groups and
    groups it itself (``dropna=False`` for null keys).  The hook asks for
    whole groups, so a group must fit one task; a hook that can be written
    with Columns (shares, ranks) should be.
    """
    # the keys as one text: exact for nulls and large integers, which pandas turns into floats
    marked = df.withColumn("_group", F.to_json(F.struct(*keys))).repartition("_group").sortWithinPartitions("_group")

    def apply(parts: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        if vectorized:
            return fn(whole.drop(columns="_group"))
        return pd.concat([fn(g.drop(columns="_group")) for _, g in whole.groupby("_group", sort=False)], ignore_index=True)

    def run(batches):
        open_: list[pd.DataFrame] = []  # parts of the group that the last batch ended in
        for batch in batches:
            if batch.empty:
                continue
            group = batch["_group"].to_numpy()
            last = len(group) - int((group[::-1] != group[-1]).argmax()) if (group != group[-1]).any() else 0
            same = bool(open_) and open_[-1]["_group"].iloc[-1] == group[0]
            if last == 0 and (same or not open_):
                open_.append(batch)
                continue
            done = [*open_, batch.iloc[:last]] if last else open_
            yield apply(done)
            open_ = [batch.iloc[last:]]
        if open_:
            yield apply(open_)

    return marked.mapInPandas(run, schema)


def pandas_group_aggregate(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """UDF4 in pandas: one output row per group from ``fn(group_frame) -> dict``.

    For hooks that need the whole group in one task; prefer
    ``aggregate_hook`` and ``pandas_partial_aggregate``, which aggregate
    partially.
    """
    def per_group(g: pd.DataFrame) -> pd.DataFrame:
        row = {k: g[k].iloc[0] for k in keys}
        row.update(fn(g))
        return pd.DataFrame([row])

    return group_transform(df, keys, per_group, schema)


def pandas_partial_aggregate(df: DataFrame, keys: list[str], partial: Callable[[pd.DataFrame], dict], schema: str,
                             merge: dict[str, Column]) -> DataFrame:
    """UDF4 in pandas by parts: ``partial`` gives the columns of ``schema`` for the rows of a group in one batch.

    ``merge`` are aggregate Columns over these parts, so no task holds a
    group: a part is one row per key and Arrow batch, and Spark combines
    parts before the shuffle.  Missing values of pandas become nulls; null
    keys form a group of their own.
    """
    # the keys as one text: exact for nulls and large integers, which pandas turns into floats
    marked = df.withColumn("_group", F.to_json(F.struct(*keys)))
    fields = T.StructType.fromDDL(schema).fields
    kinds = {f.name: to_arrow_type(f.dataType) for f in fields}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, at = [], []
            for _, g in batch.to_pandas().groupby("_group", sort=False):
                at.append(int(g.index[0]))
                rows.append(partial(g.drop(columns="_group")))
            ends = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(ends) for k in keys]
                + [pa.array([r[n] for r in rows], kind, from_pandas=True) for n, kind in kinds.items()], [*keys, *kinds])

    parts = marked.mapInArrow(run, T.StructType([*[df.schema[k] for k in keys], *fields]))
    return parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def normalize(df: DataFrame, col: str, fn: Callable[[Column], Column], out: str) -> DataFrame:
    """UDF6: a normalisation function applied before min-max scaling to [0, 1]."""
    from haulframe.operators.totals import with_totals

    d = with_totals(df, {"_lo": F.min(fn(F.col(col))), "_hi": F.max(fn(F.col(col)))})
    v, lo, hi = fn(F.col(col)), F.col("_lo"), F.col("_hi")
    return d.withColumn(out, F.when(hi == lo, F.lit(0.0)).otherwise((v - lo) / (hi - lo))).drop("_lo", "_hi")
