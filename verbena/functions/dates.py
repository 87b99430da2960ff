"""Date and time operations (the ``.dt`` accessor), ``floor_date`` and ``ceil_date``."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.functions.registry import add, column_function, lit


def prop(names: str, f: Any) -> None:
    add("elwise", names, lambda c, x: f(lit(x)), True)


def method(names: str, f: Any) -> None:
    add("elwise", names, lambda c, x, *a, **k: f(lit(x), *a, **k))


prop("dt.year", F.year)
prop("dt.quarter", F.quarter)
prop("dt.month", F.month)
prop("dt.day", F.dayofmonth)
prop("dt.hour", F.hour)
prop("dt.minute", F.minute)
prop("dt.second", F.second)
prop("dt.microsecond", lambda x: F.date_format(x, "SSSSSS").cast("int"))
prop("dt.nanosecond", lambda x: F.when(x.isNotNull(), 0))
prop("dt.dayofweek dt.weekday", F.weekday)
prop("dt.dayofyear", F.dayofyear)
prop("dt.week dt.weekofyear", F.weekofyear)
prop("dt.days_in_month dt.daysinmonth", lambda x: F.day(F.last_day(x)))
prop("dt.date", F.to_date)
prop("dt.time", lambda x: F.date_format(x, "HH:mm:ss.SSSSSS"))
prop("dt.is_leap_year", lambda x: F.day(F.last_day(F.make_date(F.year(x), F.lit(2), F.lit(1)))) == 29)
prop("dt.is_month_start", lambda x: F.day(x) == 1)
prop("dt.is_month_end", lambda x: F.to_date(x) == F.last_day(x))
prop("dt.is_quarter_start", lambda x: F.to_date(x) == F.trunc(x, "quarter"))
prop("dt.is_quarter_end", lambda x: F.to_date(x) == F.last_day(F.add_months(F.trunc(x, "quarter"), 2)))
prop("dt.is_year_start", lambda x: F.dayofyear(x) == 1)
prop("dt.is_year_end", lambda x: (F.month(x) == 12) & (F.day(x) == 31))
method("dt.day_name", lambda x: F.date_format(x, "EEEE"))
method("dt.month_name", lambda x: F.date_format(x, "MMMM"))
method("dt.normalize", lambda x: F.date_trunc("day", x))
prop("dt.total_seconds", lambda x: x.cast("interval day to second").cast("double"))
method("dt.total_seconds", lambda x: F.extract(F.lit("DAY"), x) * 86400 + F.extract(F.lit("HOUR"), x) * 3600 + F.extract(F.lit("MINUTE"), x) * 60 + F.extract(F.lit("SECOND"), x).cast("double"))
method("dt.tz_convert", lambda x, tz: F.from_utc_timestamp(x, tz))
method("dt.tz_localize", lambda x, tz: F.to_utc_timestamp(x, tz) if tz else x)

#: strftime codes and Spark's date patterns: fixed values.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "B": "MMMM", "b": "MMM", "d": "dd", "j": "DDD", "H": "HH", "I": "hh", "p": "a", "M": "mm", "S": "ss", "f": "SSSSSS", "A": "EEEE", "a": "EEE"}


def strftime(x: Column, fmt: str) -> Column:
    parts: list[str] = []
    for code, text in re.findall(r"%(.)|([^%]+)", fmt):
        if code == "%":
            parts.append("'%'")
        elif code:
            if code not in STRFTIME:
                raise ValueError(f"strftime code %{code} is not supported")
            parts.append(STRFTIME[code])
        else:
            parts.append("'" + text.replace("'", "''") + "'")
    return F.date_format(x, "".join(parts))


method("dt.strftime", strftime)

#: Offset codes: the unit that they truncate to. End codes name the last day of the unit.
STARTS = {"S": "second", "s": "second", "T": "minute", "min": "minute", "H": "hour", "h": "hour", "D": "day", "MS": "month", "QS": "quarter", "AS": "year", "YS": "year", "L": "millisecond", "ms": "millisecond", "U": "microsecond", "us": "microsecond"}
ENDS = {"M": "month", "ME": "month", "Q": "quarter", "QE": "quarter", "A": "year", "Y": "year", "YE": "year"}
STEPS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year", "millisecond": "0.001 second", "microsecond": "0.000001 second"}


def interval(text: str) -> Column:
    return F.expr(f"interval {text}" if not text.startswith("0.") else f"interval '{text.split()[0]}' second")


def floor(x: Column, unit: str) -> Column:
    if unit in STARTS:
        return F.date_trunc(STARTS[unit], x)
    if unit in ENDS:  # the last end at or before x
        start = F.date_trunc(ENDS[unit], x)
        end = start + interval(STEPS[ENDS[unit]]) - interval("1 day")
        return F.when(F.date_trunc("day", x) == end, end).otherwise(start - interval("1 day"))
    if unit in ("W", "W-SUN"):  # weeks end on Sunday
        day = F.date_trunc("day", x)
        return F.when(F.weekday(x) == 6, day).otherwise(F.date_trunc("week", x) - interval("1 day"))
    raise ValueError(f"date unit {unit!r}")


def ceil(x: Column, unit: str) -> Column:
    low = floor(x, unit)
    if unit in STARTS:
        up = low + interval(STEPS[STARTS[unit]])
    elif unit in ENDS:
        up = F.date_trunc(ENDS[unit], low + interval("1 day")) + interval(STEPS[ENDS[unit]]) - interval("1 day")
    else:
        up = low + interval("7 days")
    return F.when(x == low, low).otherwise(up)


def nearest(x: Column, unit: str) -> Column:
    """The nearer of floor and ceiling; a tie goes to the even count of units, as rounding halves does."""
    low, high = floor(x, unit), ceil(x, unit)
    return F.when(low == high, low).when(x - low < high - x, low).when(x - low > high - x, high).otherwise(F.when(F.pmod(F.datediff(low, F.lit("1970-01-01").cast("date")), F.lit(2)) == 0, low).otherwise(high))


method("dt.floor", floor)
method("dt.ceil", ceil)
method("dt.round", nearest)


def as_time(c: Any, x: Any) -> Column:
    """Dates as times, so that truncation keeps one type."""
    return lit(x).cast("timestamp_ntz") if isinstance(c.dtype(lit(x)), T.DateType) else lit(x)


@column_function("elwise")
def floor_date(c, x, unit="S"):
    """The start of the unit that ``x`` is in; for end codes (``M``, ``Q``, ``A``, ``W``) the last end up to ``x``."""
    return floor(as_time(c, x), unit)


@column_function("elwise")
def ceil_date(c, x, unit="S"):
    """``x`` if it stands on the unit's edge, else the next edge."""
    return ceil(as_time(c, x), unit)
