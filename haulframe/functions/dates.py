"""DAT1-DAT7: calendar arithmetic as Column expressions (UTC, timestamp without zone).

Month arithmetic clamps the day of month; differences in months follow the
anchor interpolation of the reference's date library (not Spark's
``months_between``, which assumes 31-day months).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.operators.totals import with_totals

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# Relative-time rounding thresholds: seconds "a few" up to 44, seconds below
# 45, minutes below 45, hours below 22, days below 26, months below 11.
REL_THRESHOLDS = {"ss": 44, "s": 45, "m": 45, "h": 22, "d": 26, "M": 11}
# English relative-time phrases.
REL_PHRASES = {
    "s": "a few seconds", "ss": "%d seconds", "m": "a minute", "mm": "%d minutes",
    "h": "an hour", "hh": "%d hours", "d": "a day", "dd": "%d days",
    "M": "a month", "MM": "%d months", "y": "a year", "yy": "%d years",
}
REL_FUTURE, REL_PAST = "in %s", "%s ago"
# Days per month used to turn a duration in days into months (400-year cycle).
DAYS_PER_400_YEARS, MONTHS_PER_400_YEARS = 146097, 4800
# ---------------------------------------------------------------------------

UNITS = ("year", "quarter", "month", "week", "isoweek", "day", "hour", "minute", "second")
_NEXT = {"year": "1 YEAR", "quarter": "3 MONTHS", "month": "1 MONTH", "week": "7 DAYS", "isoweek": "7 DAYS",
         "day": "1 DAY", "hour": "1 HOUR", "minute": "1 MINUTE", "second": "1 SECOND"}


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def instant(value: dt.datetime | dt.date | str) -> Column:
    """A literal wall-clock instant; a plain literal would be read in the session's time zone."""
    return F.lit(str(value)).cast("timestamp_ntz")


def start_of(c: Column, unit: str) -> Column:
    """DAT1: start of the unit; 'week' starts on Sunday, 'isoweek' on Monday."""
    ts = _ntz(c)
    if unit == "week":
        out = F.date_trunc("week", ts + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")
    elif unit == "isoweek":
        out = F.date_trunc("week", ts)
    else:
        out = F.date_trunc(unit, ts)
    return out.cast("timestamp_ntz")


def end_of(c: Column, unit: str) -> Column:
    """DAT1: last millisecond of the unit (next start - 1 ms)."""
    return start_of(c, unit) + F.expr(f"INTERVAL {_NEXT[unit]}") - F.expr("INTERVAL 0.001 SECOND")


def shift(c: Column, months: int = 0, days: int = 0, ms: int = 0) -> Column:
    """DAT2: add months (day clamped, time kept), then days, then milliseconds."""
    ts = _ntz(c)
    if months:
        ts = ts + F.make_ym_interval(F.lit(0), F.lit(months))
    if days:
        ts = ts + F.make_dt_interval(F.lit(days))
    if ms:
        ts = F.timestamp_add("MILLISECOND", F.lit(ms), ts)
    return ts


def _ms(c: Column) -> Column:
    """Milliseconds since 1970 of a wall-clock instant, whatever the session's time zone."""
    t = _ntz(c)
    seconds = (F.unix_date(t.cast("date")) * 24 + F.hour(t)) * 3600 + F.minute(t) * 60
    # microseconds as a rounded double: exact, and much faster than decimal arithmetic
    micros = F.round(F.extract(F.lit("SECOND"), t).cast("double") * 1e6)
    return seconds.cast("bigint") * 1000 + F.floor(micros / 1000).cast("bigint")


def _add_months(ts: Column, n: Column) -> Column:
    return ts + F.make_ym_interval(F.lit(0), n.cast("int"))


def _ms_of_day(c: Column) -> Column:
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    return seconds.cast("bigint") * 1000 + F.floor(F.round(F.extract(F.lit("SECOND"), c).cast("double") * 1e6) / 1000).cast("bigint")


def month_diff(a: Column, b: Column) -> Column:
    """Months from b to a (a - b), fractional.

    Months are counted from the instant with the greater day of month, a on
    a tie: whole months towards the other, and of the month that it falls
    into the share in milliseconds.  Instants are pairs of a date and a time
    of day, so all steps are integer arithmetic on days.
    """
    a, b = _ntz(a), _ntz(b)
    from_b = F.dayofmonth(a) < F.dayofmonth(b)
    day_a, day_b, time_a, time_b = a.cast("date"), b.cast("date"), _ms_of_day(a), _ms_of_day(b)
    origin, other = F.when(from_b, day_b).otherwise(day_a), F.when(from_b, day_a).otherwise(day_b)
    later = F.when(from_b, time_a - time_b).otherwise(time_b - time_a)  # how much later in the day the other is
    apart = (F.year(other) - F.year(origin)) * 12 + F.month(other) - F.month(origin)
    reached = F.add_months(origin, apart)
    low = apart - F.when((reached > other) | ((reached == other) & (later < 0)), 1).otherwise(0)
    begin = F.add_months(origin, low)
    day = 864e5
    share = (F.date_diff(other, begin) * day + later) / (F.date_diff(F.add_months(origin, low + 1), begin) * day)
    return (low + share) * F.when(from_b, 1.0).otherwise(-1.0) + F.lit(0.0)


def diff(a: Column, b: Column, unit: str, as_float: bool = False) -> Column:
    """DAT3: a - b in ``unit``; truncated toward zero unless ``as_float``."""
    if unit in ("year", "month", "quarter"):
        out = month_diff(a, b) / {"year": 12, "month": 1, "quarter": 3}[unit]
    else:
        per = {"second": 1e3, "minute": 6e4, "hour": 36e5, "day": 864e5, "week": 6048e5, "millisecond": 1.0}[unit]
        out = (_ms(a) - _ms(b)) / per
    if as_float:
        return out
    return out.cast("bigint")  # cuts towards zero


def is_between(c: Column, lo, hi, unit: str | None = None, inclusivity: str = "()") -> Column:
    """DAT4: between two instants at a granularity with '()', '[]', '[)' or '(]' bounds.

    After ``lo`` at a unit means the start of the value's unit is later than
    ``lo``; before ``hi`` means the end of its unit is earlier than ``hi``.
    """
    ts = _ntz(c)
    lo_c, hi_c = instant(lo), instant(hi)
    s = start_of(ts, unit) if unit else ts
    e = end_of(ts, unit) if unit else ts
    after_lo = s > lo_c
    not_before_lo = ~(e < lo_c)
    before_hi = e < hi_c
    not_after_hi = ~(s > hi_c)
    left = after_lo if inclusivity[0] == "(" else not_before_lo
    right = before_hi if inclusivity[1] == ")" else not_after_hi
    return left & right


def choose_bucket(span_days: Column) -> Column:
    """DAT5: axis bucket name from the span in days.

    Fixed thresholds: more than 5 years, 800, 180, 90, 60, 30 and 2 days,
    then 2.4 hours, 15, 5 and 1 minutes and 20 seconds.
    """
    hours, minutes = span_days * 24, span_days * 1440
    seconds = minutes * 60
    out = (F.when(span_days / 365 > 5, "years").when(span_days > 800, "half_year")
           .when(span_days > 180, "months").when(span_days > 90, "months_fortnight")
           .when(span_days > 60, "months_days").when(span_days > 30, "week_days")
           .when(span_days > 2, "days").when(hours > 2.4, "hours").when(minutes > 15, "minutes_fives")
           .when(minutes > 5, "minutes").when(minutes > 1, "seconds_tens").when(seconds > 20, "seconds_fives")
           .otherwise("seconds"))
    return out


def bucket_start(c: Column, name: Column) -> Column:
    """DAT5: start of the bucket ``name`` containing ``c``."""
    ts = _ntz(c)
    month = F.date_trunc("month", ts)
    secs = F.floor(_ms(ts) / 1000).cast("bigint")

    def every(n: int) -> Column:
        return F.timestamp_add("SECOND", (F.floor(secs / n) * n).cast("bigint"), instant("1970-01-01 00:00:00"))

    half = F.make_timestamp_ntz(F.year(ts), F.when(F.month(ts) <= 6, 1).otherwise(7), F.lit(1),
                                F.lit(0), F.lit(0), F.lit(0))
    fortnight = F.when(F.dayofmonth(ts) < 16, month).otherwise(month + F.expr("INTERVAL 15 DAYS"))
    return (F.when(name == "years", F.date_trunc("year", ts)).when(name == "half_year", half)
            .when(name == "months", month).when(name == "months_fortnight", fortnight)
            .when(name == "months_days", F.date_trunc("week", ts))
            .when(name.isin("week_days", "days"), F.date_trunc("day", ts))
            .when(name == "hours", F.date_trunc("hour", ts)).when(name == "minutes_fives", every(300))
            .when(name == "minutes", F.date_trunc("minute", ts)).when(name == "seconds_tens", every(10))
            .when(name == "seconds_fives", every(5)).otherwise(F.date_trunc("second", ts))).cast("timestamp_ntz")


def auto_bucket(df: DataFrame, ts: str) -> DataFrame:
    """DAT5: count rows per automatically chosen time bucket (span from one min/max aggregate)."""
    d = with_totals(df.select(ts), {"_lo": F.min(ts), "_hi": F.max(ts)})
    d = d.withColumn("_interval", choose_bucket((_ms(F.col("_hi")) - _ms(F.col("_lo"))) / 864e5))
    return d.groupBy(F.col("_interval").alias("interval"), bucket_start(F.col(ts), F.col("_interval")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


BREAKDOWN_NAMES = ["years", "months", "weeks", "days", "hours", "minutes", "seconds"]
UNIT_SECONDS = {"W": 604800, "D": 86400, "H": 3600, "M": 60, "S": 1}
# Fixed value: the weeks that count as a month where a rounded-up rest may fill one.
WEEKS_IN_MONTH = 4.3482


def breakdown(df: DataFrame, a: str, b: str, units: str = "YOWDHMS", since: bool = False) -> DataFrame:
    """DAT6: add years, months, weeks, days, hours, minutes, seconds from a to b.

    Units left out of ``units`` are 0 and absorbed by the next shown smaller
    one.  Unless ``since`` (time passed, not time left), the time below the
    last shown unit is rounded up to one more of it.  b before a gives all
    zeros.

    Whole months are those whose addition to a (the last day of a month
    going to the last day) does not pass b; the rest is plain seconds.  A
    rest rounded up to a whole number of the largest unit below the month
    counts as one more month (or year) where it is as long as one.
    Intermediate values are staged as columns so the generated code stays
    small.
    """
    names = dict(zip("YOWDHMS", BREAKDOWN_NAMES))
    start, end = F.col("_start"), F.col("_end")
    d = df.withColumn("_start", F.date_trunc("second", _ntz(F.col(a))).cast("timestamp_ntz")).withColumn("_end", _ntz(F.col(b)))
    d = d.withColumn("_passed", _ms(end) < _ms(start))
    calendar = [u for u in "YO" if u in units]
    if calendar:
        # both days of month within the shorter of the two months, then the time of day
        days = F.least(F.dayofmonth(F.last_day(start)), F.dayofmonth(F.last_day(end)))

        def place(t: Column) -> Column:
            return F.struct(F.least(F.dayofmonth(t), days), F.hour(t), F.minute(t), F.floor(F.second(t)))

        whole = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(place(end) < place(start), 1).otherwise(0)
        d = d.withColumn("_months", F.greatest(whole, F.lit(0)))
        d = d.withColumn("years", F.floor(F.col("_months") / 12) if "Y" in units else F.lit(0))
        d = d.withColumn("months", F.col("_months") - F.col("years") * 12 if "O" in units else F.lit(0))
        moved = _add_months(start, F.col("years") * 12 + F.col("months"))
        to_last = F.dayofmonth(F.last_day(moved)) - F.dayofmonth(moved)
        at_last = start.cast("date") == F.last_day(start)
        d = d.withColumn("_start", F.timestamp_add("DAY", F.when(at_last, to_last).otherwise(0), moved))
    else:
        d = d.withColumn("years", F.lit(0)).withColumn("months", F.lit(0))
    d = d.withColumn("_rest", F.floor((_ms(end) - _ms(start)) / 1000))
    shown = [u for u in UNIT_SECONDS if u in units]
    rest = F.col("_rest")
    if shown and not since:
        smallest, largest = UNIT_SECONDS[shown[-1]], UNIT_SECONDS[shown[0]]
        d = d.withColumn("_up", F.ceil(rest / smallest) * smallest)
        month = WEEKS_IN_MONTH * UNIT_SECONDS["W"] * (1 if "O" in units else 12)
        fills = (F.col("_up") > rest) & (F.col("_up") % largest == 0) & (F.col("_up") >= month)
    else:
        d = d.withColumn("_up", rest)
        fills = F.lit(not since) & (rest > 0)
    if calendar:
        d = d.withColumn("_fills", fills).withColumn("_up", F.when(F.col("_fills") & F.lit(bool(shown)), 0).otherwise(F.col("_up")))
        step = F.col("_fills").cast("int")
        if "O" in units:
            d = d.withColumn("_months", F.col("years") * 12 + F.col("months") + step)
            d = d.withColumn("years", F.floor(F.col("_months") / 12) if "Y" in units else F.lit(0))
            d = d.withColumn("months", F.col("_months") - F.col("years") * 12)
        else:
            d = d.withColumn("years", F.col("years") + step)
    larger = None
    for u in UNIT_SECONDS:
        left = F.col("_up") if larger is None else F.pmod(F.col("_up"), F.lit(UNIT_SECONDS[larger]))
        d = d.withColumn(names[u], F.floor(left / UNIT_SECONDS[u]) if u in units else F.lit(0))
        larger = u if u in units else larger
    for name in BREAKDOWN_NAMES:
        d = d.withColumn(name, F.when(F.col("_passed"), F.lit(0)).otherwise(F.col(name)).cast("bigint"))
    return d.drop("_start", "_end", "_passed", "_months", "_rest", "_up", "_fills")


def _jsround(x: Column) -> Column:
    return F.floor(x + 0.5)


def age_label(a: Column, b: Column, with_suffix: bool = True) -> Column:
    """DAT7: relative-time label of b measured from a ('5 minutes ago', 'in 2 months')."""
    ms = _ms(b) - _ms(a)
    d = F.abs(ms)
    days_f = d / 864e5
    secs, mins = _jsround(d / 1e3), _jsround(d / 6e4)
    hours, days = _jsround(d / 36e5), _jsround(days_f)
    months_f = days_f * MONTHS_PER_400_YEARS / DAYS_PER_400_YEARS
    months, years = _jsround(months_f), _jsround(months_f / 12)
    t = REL_THRESHOLDS

    def fmt(key, n=None):
        p = REL_PHRASES[key]
        return F.lit(p) if n is None else F.replace(F.lit(p), F.lit("%d"), n.cast("bigint").cast("string"))

    text = (F.when(secs <= t["ss"], fmt("s")).when(secs < t["s"], fmt("ss", secs))
            .when(mins <= 1, fmt("m")).when(mins < t["m"], fmt("mm", mins))
            .when(hours <= 1, fmt("h")).when(hours < t["h"], fmt("hh", hours))
            .when(days <= 1, fmt("d")).when(days < t["d"], fmt("dd", days))
            .when(months <= 1, fmt("M")).when(months < t["M"], fmt("MM", months))
            .when(years <= 1, fmt("y")).otherwise(fmt("yy", years)))
    if not with_suffix:
        return text
    return F.when(ms > 0, F.replace(F.lit(REL_FUTURE), F.lit("%s"), text)).otherwise(
        F.replace(F.lit(REL_PAST), F.lit("%s"), text))
