"""FLT1-FLT15, PRJ1-PRJ3: table filtering, search and projection.

Search texts, patterns and specs are parsed on the driver (they are small
parameters); the per-row test is one Column expression, so Catalyst pushes
the parts it can (equality, IN, startswith) into the Parquet scan and the
rest runs inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.functions.dates import instant
from haulframe.functions.strings import fold_accents, html_unescape, js_text

# The signs of a comparison typed into a search box, e.g. ">10", "<= 5", "10<".
COMPARISON_SIGNS = ("<=", "=>", "=<", ">=", ">", "<")


def _and(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs) if cs else F.lit(True)


def _or(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs) if cs else F.lit(False)


def _dtype(df: DataFrame, col: str) -> T.DataType:
    return df.select(col).schema.fields[0].dataType


def _int_prefix(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?\d+)", 1), F.lit("")).try_cast("bigint")


def parse_comparison(text: str, signed: bool = True) -> tuple[str, int | None] | None:
    """(comparison of the cell against the number, number) typed into a search box, else None.

    The comparison is one of ``<``, ``<=``, ``>``, ``>=``; ``10 <`` means
    that 10 is below the cell, so it is turned round.  The number is None
    when only a sign was typed.
    """
    at, sign = min(((text.index(s), s) for s in COMPARISON_SIGNS if s in text), key=lambda f: (f[0], -len(f[1])), default=(0, ""))
    if not sign:
        return None
    left, right = text[:at], text[at + len(sign):].lstrip()
    number = _number_at_end(left.rstrip(), signed)
    turned = bool(number) or left != left.rstrip()  # a sign behind white space belongs to what stands before it
    if not turned:
        number = _number_at_start(right, signed)
    above = (">" in sign) != turned
    return (">" if above else "<") + ("=" if "=" in sign else ""), int(number) if number else None


def _number_at_end(text: str, signed: bool) -> str:
    digits = len(text) - len(text.rstrip("0123456789"))
    number = text[len(text) - digits:]
    return "-" + number if number and signed and text[:-digits].endswith("-") else number


def _number_at_start(text: str, signed: bool) -> str:
    minus = "-" if signed and text.startswith("-") else ""
    rest = text[len(minus):]
    number = rest[:len(rest) - len(rest.lstrip("0123456789"))]
    return minus + number if number else ""


def _compare(cell_text: Column, op: str, num: int | None) -> Column:
    if num is None:
        return F.lit(False)
    cell = _int_prefix(cell_text)
    holds = {">": cell > num, ">=": cell >= num, "<": cell < num, "<=": cell <= num}[op]
    return F.coalesce(holds, F.lit(False))


def java_regex(pattern: str) -> str | None:
    """'/re/flags' or a bare pattern (flags gim) -> an embedded-flag Java regex.

    The pattern is checked by the engine that will run it; one that does not
    compile there matches nothing (None).
    """
    m = re.match(r"^/(.*?)/([gim]*)$", pattern)
    body, flags = (m.group(1), m.group(2)) if m else (pattern, "gim")
    emb = "".join(f for f in "im" if f in flags)
    whole = f"(?{emb}){body}" if emb else body
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(whole)
    except (Py4JJavaError, PySparkException):
        return None
    return whole


# ---------------------------------------------------------------------------
# FLT1 / WIN3


def lookup_first(df: DataFrame, keys: DataFrame, key_col: str, id_col: str, input_col: str = "key") -> DataFrame:
    """FLT1: for each input key (lower-cased), the stored row with the lowest id.

    Stored keys are compared as stored.  The stored side is reduced to one
    row per key with ``min_by`` (a partial aggregate, so a key held by a
    third of the table is combined map-side) before the join.
    """
    k = keys.select(F.lower(F.col(input_col)).alias("_lookup")).distinct()
    cand = df.join(k, df[key_col] == k["_lookup"], "left_semi")
    first = cand.groupBy(key_col).agg(F.min_by(F.struct(*df.columns), F.col(id_col)).alias("_r"))
    return k.join(first, k["_lookup"] == first[key_col], "left").select(
        F.col("_lookup").alias("lookup_key"), "_r.*")


# ---------------------------------------------------------------------------
# FLT2


def filter_by(df: DataFrame, spec: dict, how: str = "and") -> DataFrame:
    """FLT2: {col: value | [values]} combined with and/or; an empty spec keeps all."""
    if not spec:
        return df
    tests = []
    for col, val in spec.items():
        if isinstance(val, (list, tuple, set)):
            tests.append(F.col(col).isin(list(val)))
        elif val is None:
            tests.append(F.col(col).isNull())
        else:
            # plain equality (not null-safe) so the Parquet reader gets an EqualTo filter
            tests.append(F.coalesce(F.col(col) == F.lit(val), F.lit(False)) if how == "or" else F.col(col) == F.lit(val))
    return df.where(_and(tests) if how == "and" else _or(tests))


# ---------------------------------------------------------------------------
# FLT3-FLT6: global search


def search(df: DataFrame, text: str, cols: list[str], mode: str = "contains",
           accent_neutral: bool = False) -> DataFrame:
    """FLT3 (contains), FLT4 (strict), FLT5 (regex), FLT6 (comparison OR contains).

    Only string and number cells take part.  In the default mode a typed
    comparison such as '>10' or '10<' is OR-ed with the plain contains.
    """
    if text is None or text == "":
        return df
    if accent_neutral:
        text = "".join(ch for ch in unicodedata.normalize("NFD", text) if not 0x0300 <= ord(ch) <= 0x036F)
    needle = text.lower()
    tests = []
    cmp = parse_comparison(text, signed=True) if mode == "contains" else None
    rx = java_regex(text) if mode == "regex" else None
    for c in cols:
        cell = js_text(F.col(c), _dtype(df, c))
        if accent_neutral:
            cell = fold_accents(cell)
        if mode == "strict":
            t = F.lower(cell) == F.lit(needle)
        elif mode == "regex":
            t = cell.rlike(rx) if rx is not None else F.lit(False)
        else:
            t = F.lower(cell).contains(needle)
            if cmp is not None:
                t = _compare(cell, *cmp) | t
        tests.append(F.coalesce(t, F.lit(False)))
    return df.where(_or(tests))


# ---------------------------------------------------------------------------
# FLT7: per-column filters


def _value_test(cell: Column, fval: str, mode: str) -> Column:
    if mode == "strict":
        t = F.lower(cell) == F.lit(fval)
    elif mode == "startswith":
        t = F.lower(cell).startswith(fval)
    elif mode == "date":
        t = cell.try_cast("timestamp") == F.lit(fval).try_cast("timestamp")
    elif mode == "regex":
        rx = java_regex(fval)
        t = cell.rlike(rx) if rx is not None else F.lit(False)
    else:
        t = F.lower(cell).contains(fval)
    cmp = parse_comparison(fval, signed=False)
    if cmp is not None:
        t = _compare(cell, *cmp)
    return F.coalesce(t, F.lit(False))


def column_filters(df: DataFrame, specs: dict, delimiter: str | None = None) -> DataFrame:
    """FLT7: AND over columns of (OR over delimited values) of one test each.

    spec per column: {"value": text, "mode": contains|startswith|strict|date|regex}.
    Array cells match when any element matches, map cells when any value
    matches; a null cell never matches; an empty value keeps the row.
    """
    tests = []
    for col, spec in specs.items():
        raw = (spec.get("value") or "").lower()
        vals = raw.split(delimiter) if delimiter else [raw]
        vals = [v.strip() for v in vals]
        if any(v == "" for v in vals):
            continue
        dtype = _dtype(df, col)
        mode = spec.get("mode", "contains")

        def one(x: Column, dt_: T.DataType) -> Column:
            cell = js_text(x, dt_)
            if isinstance(dt_, T.StringType):
                cell = html_unescape(cell)
            return _or([_value_test(cell, v, mode) for v in vals])

        if isinstance(dtype, T.ArrayType):
            t = F.exists(F.col(col), lambda x: one(x, dtype.elementType))
        elif isinstance(dtype, T.MapType):
            t = F.exists(F.map_values(F.col(col)), lambda x: one(x, dtype.valueType))
        elif isinstance(dtype, T.BooleanType):
            t = one(F.when(F.col(col), "true").otherwise("false"), T.StringType())
        else:
            t = one(F.col(col), dtype)
        tests.append(F.coalesce(t, F.lit(False)))
    return df.where(_and(tests))


# ---------------------------------------------------------------------------
# FLT8, FLT10, FLT11, FLT12


def advanced_search(df: DataFrame, spec: dict) -> DataFrame:
    """FLT8: every given column must contain its text (case-insensitive)."""
    tests = [F.coalesce(F.lower(js_text(F.col(c), _dtype(df, c))).contains(v.lower()), F.lit(False))
             for c, v in spec.items() if v]
    return df.where(_and(tests))


def dynamic_filter(df: DataFrame, specs: dict) -> DataFrame:
    """FLT10: keys prefixed '&' must all match; of the others at least one must.

    specs: {"col" or "&col": value}.
    """
    hard = [F.col(k[1:]).eqNullSafe(F.lit(v)) for k, v in specs.items() if k.startswith("&")]
    soft = [F.col(k).eqNullSafe(F.lit(v)) for k, v in specs.items() if not k.startswith("&")]
    cond = _and(hard)
    if soft:
        cond = cond & _or(soft)
    return df.where(cond)


def prefix_filter(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """FLT11: code column starts with prefix (pushed to the Parquet scan)."""
    return df.where(F.col(col).startswith(prefix))


def category_filter(df: DataFrame, col: str, value: str) -> DataFrame:
    """FLT12: 'all' keeps everything, any other value is an equality test."""
    return df if value == "all" else df.where(F.col(col) == value)


# ---------------------------------------------------------------------------
# FLT13: date-range presets

PRESETS = ("today", "yesterday", "last_7_days", "last_30_days", "this_month", "last_month")


def preset_bounds(preset: str, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Half-open [lo, hi) day bounds of a preset relative to ``as_of``."""
    one = dt.timedelta(days=1)
    if preset == "today":
        return as_of, as_of + one
    if preset == "yesterday":
        return as_of - one, as_of
    if preset == "last_7_days":
        return as_of - 6 * one, as_of + one
    if preset == "last_30_days":
        return as_of - 29 * one, as_of + one
    first = as_of.replace(day=1)
    if preset == "this_month":
        nxt = (first + 32 * one).replace(day=1)
        return first, nxt
    if preset == "last_month":
        prev = (first - one).replace(day=1)
        return prev, first
    raise ValueError(preset)


def date_range(df: DataFrame, ts_col: str, preset: str, as_of: dt.date, min_date: dt.date | None = None,
               max_date: dt.date | None = None, max_span_days: int | None = None) -> DataFrame | None:
    """FLT13: rows whose timestamp falls in the preset range.

    The range is clamped to [min_date, max_date] and to max_span days from
    its start; a preset that ends before min_date or starts after max_date
    is impossible and is dropped (None).  Bounds are literals, so the
    filter reaches the Parquet scan.
    """
    lo, hi = preset_bounds(preset, as_of)
    if min_date and hi <= min_date or max_date and lo > max_date:
        return None
    if min_date and lo < min_date:
        lo = min_date
    if max_date and hi > max_date + dt.timedelta(days=1):
        hi = max_date + dt.timedelta(days=1)
    if max_span_days and (hi - lo).days > max_span_days:
        hi = lo + dt.timedelta(days=max_span_days)
    return df.where((F.col(ts_col) >= instant(lo)) & (F.col(ts_col) < instant(hi)))


# ---------------------------------------------------------------------------
# FLT14, FLT15


def smart_search(df: DataFrame, text: str, cols: list[str], smart: bool = True, regex: bool = False,
                 case_insensitive: bool = True, exact: bool = False, boundary: bool = False) -> DataFrame:
    """FLT14: search over the row text (columns joined by spaces).

    smart: words (and "quoted phrases") must all occur, in any order;
    exact: the row text equals the search; boundary: each word must start
    at a word boundary; regex: the search is a pattern.
    """
    row = F.concat_ws(" ", *[js_text(F.col(c), _dtype(df, c)) for c in cols])
    flags = "(?i)" if case_insensitive else ""
    if exact:
        return df.where(F.lower(row) == text.lower() if case_insensitive else row == text)
    if regex:
        pattern = java_regex(f"/{text}/{'i' if case_insensitive else ''}")
        # a pattern that does not compile matches nothing, as in the other searches
        return df.where(row.rlike(pattern) if pattern is not None else F.lit(False))
    words = [w.strip('"') for w in re.findall(r'"[^"]*"|\S+', text)] if smart else [text]
    tests = []
    for w in words:
        if not w:
            continue
        pat = re.escape(w)
        if boundary:
            pat = r"\b" + pat
        tests.append(row.rlike(flags + pat))
    return df.where(_and(tests))


def all_words(df: DataFrame, query: str, col: str, out: str = "matched") -> DataFrame:
    """FLT15: every query word must be found in the text, each hit consumed once.

    Words are matched case-insensitively in order; a found occurrence is
    blanked out of the working text, so a repeated query word needs a second
    occurrence.  Runs as one ``aggregate`` higher-order function per row.
    """
    words = [w for w in query.lower().split() if w]
    init = F.struct(F.lower(F.col(col)).alias("rest"), F.lit(True).alias("ok"))

    expr = F.aggregate(
        F.array(*[F.lit(w) for w in words]), init,
        lambda acc, w: F.struct(
            F.when(F.instr(acc["rest"], w) > 0,
                   F.overlay(acc["rest"], F.repeat(F.lit(" "), F.length(w)), F.instr(acc["rest"], w)))
            .otherwise(acc["rest"]).alias("rest"),
            (acc["ok"] & (F.instr(acc["rest"], w) > 0)).alias("ok")),
        lambda acc: acc["ok"])
    return df.withColumn(out, F.coalesce(expr, F.lit(False)))


# ---------------------------------------------------------------------------
# PRJ1-PRJ3


def project(df: DataFrame, visible: list[str] | None = None, force: list[str] | None = None,
            ignore: list[str] | None = None) -> DataFrame:
    """PRJ1: visible columns plus forced ones, minus ignored ones, in table order."""
    vis = set(visible if visible is not None else df.columns) | set(force or [])
    keep = [c for c in df.columns if c in vis and c not in set(ignore or [])]
    return df.select(*keep)


def path(df: DataFrame, dotted: str, out: str | None = None, json_col: str | None = None) -> DataFrame:
    """PRJ2: value at a dotted path, null when any step is missing.

    On a struct column Spark's field access already propagates nulls; for a
    JSON text column the path becomes a JSON path.
    """
    name = out or dotted.replace(".", "_")
    if json_col:
        return df.withColumn(name, F.get_json_object(F.col(json_col), "$." + dotted))
    if dotted in df.columns:
        return df.withColumn(name, F.col(f"`{dotted}`"))
    return df.withColumn(name, F.col(dotted))


def format_rows(df: DataFrame, formatters: dict[str, Column]) -> DataFrame:
    """PRJ3: one display column per formatter; columns without one are dropped."""
    return df.select(*[expr.alias(name) for name, expr in formatters.items()])


def first_per_key(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """WIN3: first row per key by lowest id (``min_by``: partial, skew-safe)."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(id_col)).alias("_r")).select("_r.*")
