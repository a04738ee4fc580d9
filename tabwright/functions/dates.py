"""Reading dates out of cells, and calendar periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C
from .text import is_number, is_text, let, strip, western_digits

# Month names in full or shortened, and days of the week before a date.
_MONTH = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
          r"|nov(?:ember)?|dec(?:ember)?)")
_WEEKDAY = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"

# a time of day with an optional half of the day (AM, PM) and an offset that is dropped
_TIME = (r"(?:[T\s]\s*([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)(?:\s*((?i:[ap]))\.?(?i:m)\.?)?"
         r"(?:\s*(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?)?\z")
_YEAR_FIRST = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + _TIME
_YEAR_LAST = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})" + _TIME
_COMPACT = r"^((?:19|20)[0-9]{2})(0[1-9]|1[0-2])([0-3][0-9])" + _TIME
_DAY_MONTH = r"(?i)^([0-9]{1,2})(?:st|nd|rd|th)?[\s-]+" + _MONTH + r"\.?[\s,-]+([0-9]{4}|[0-9]{2})" + _TIME
_MONTH_DAY = r"(?i)^" + _MONTH + r"\.?[\s-]+([0-9]{1,2})(?:st|nd|rd|th)?(?:,?\s+|-)([0-9]{4}|[0-9]{2})" + _TIME
_YEAR_NAME = r"(?i)^([0-9]{4})[\s,-]+" + _MONTH + r"\.?[\s-]+([0-9]{1,2})(?:st|nd|rd|th)?" + _TIME
_NAME_YEAR = r"(?i)^" + _MONTH + r"\.?[\s,-]+([0-9]{4})\z"
_YEAR_MONTH = r"^([0-9]{4})[-/]([0-9]{1,2})\z"
_MONTH_YEAR = r"^([0-9]{1,2})[-/]([0-9]{4})\z"
_SERIAL = r"^[0-9]{5}(?:\.[0-9]+)?\z"


def _serial(days: Column) -> Column:
    """Spreadsheet day number -> timestamp_ntz; NULL outside the accepted range."""
    seconds = F.round(days * 86400, 3).cast("decimal(18,6)")
    moment = (F.lit(C.SERIAL_EPOCH).cast("timestamp_ntz")
              + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))
    return F.when(days.between(C.SERIAL_MIN, C.SERIAL_MAX), moment)


def _full_year(y: Column) -> Column:
    """Two-digit years fall within 50 years of today."""
    near = y.try_cast("int") + 2000
    return F.when(F.length(y) == 4, y.try_cast("int")).when(
        near >= F.year(F.current_date()) + 50, near - 100).otherwise(near)


def _moment(year: Column, month: Column, day: Column, time: Column, half: Column) -> Column:
    hour = F.regexp_extract(time, r"^[0-9]{1,2}", 0).try_cast("int")
    late = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    clock = F.when(half == "", time).otherwise(F.concat(late.cast("string"), F.regexp_extract(time, r":.*$", 0)))
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), month.cast("string"), F.lit("-"), day,
                    F.when(time != "", F.concat(F.lit(" "), clock)).otherwise(F.lit("")))
    return text.try_cast("timestamp_ntz")


def parse_date(c: Column, dtype: T.DataType, day_first: bool = True) -> Column:
    """The moment in a cell as timestamp_ntz, NULL when there is none.

    Year-first text is always year, month, day; other numeric dates follow ``day_first`` and fall back
    to the other order when that is the only possible reading. Month names in any order, weekdays before the date,
    times with or without AM and PM, offsets (dropped), ``yyyyMMdd``, a month with its year (its first day) and
    spreadsheet day numbers, also as text, are read too.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if is_number(dtype):
        return _serial(c.cast("double"))
    if not is_text(dtype):
        return F.lit(None).cast("timestamp_ntz")
    return F.coalesce(_quick_date(c, day_first),
                      let(F.regexp_replace(strip(western_digits(c)), _WEEKDAY, ""), lambda t: _careful_date(t, day_first)))


def _quick_date(c: Column, day_first: bool) -> Column:
    """Ten-character dates and day numbers, without regular expressions where possible."""
    marks = ("-", "/", ".")

    def cut(start: int, size: int) -> Column:
        return F.substring(c, start, size)

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("timestamp_ntz")

    year_first = cut(5, 1).isin(*marks) & cut(8, 1).isin(*marks)
    year_last = cut(3, 1).isin(*marks) & cut(6, 1).isin(*marks)
    d, m = (cut(1, 2), cut(4, 2)) if day_first else (cut(4, 2), cut(1, 2))
    return (F.when((F.length(c) == 10) & year_first, day(cut(1, 4), cut(6, 2), cut(9, 2)))
            .when((F.length(c) == 10) & year_last, F.coalesce(day(cut(7, 4), m, d), day(cut(7, 4), d, m)))
            .when((F.length(c) == 5) & c.rlike("^[0-9]{5}"), _serial(c.try_cast("double"))))


def _careful_date(t: Column, day_first: bool) -> Column:
    """All forms, from trimmed text with western digits."""
    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(t, pattern, i)

    def month(pattern: str, i: int) -> Column:
        stem = F.lower(F.substring(part(pattern, i), 1, 3))
        return ((F.instr(F.lit(C.MONTH_STEMS), stem) + 3) / 4).cast("int")

    def clock(pattern: str) -> list[Column]:
        return [part(pattern, 4), part(pattern, 5)]

    y, first, second = _full_year(part(_YEAR_LAST, 3)), part(_YEAR_LAST, 1), part(_YEAR_LAST, 2)
    d, m = (first, second) if day_first else (second, first)
    one, none = F.lit("1"), [F.lit(""), F.lit("")]
    return (
        F.when(t.rlike(_YEAR_FIRST), _moment(*[part(_YEAR_FIRST, i) for i in (1, 2, 3)], *clock(_YEAR_FIRST)))
        .when(t.rlike(_YEAR_LAST), F.coalesce(_moment(y, m, d, *clock(_YEAR_LAST)), _moment(y, d, m, *clock(_YEAR_LAST))))
        .when(t.rlike(_COMPACT), _moment(*[part(_COMPACT, i) for i in (1, 2, 3)], *clock(_COMPACT)))
        .when(t.rlike(_DAY_MONTH), _moment(_full_year(part(_DAY_MONTH, 3)), month(_DAY_MONTH, 2), part(_DAY_MONTH, 1),
                                           *clock(_DAY_MONTH)))
        .when(t.rlike(_MONTH_DAY), _moment(_full_year(part(_MONTH_DAY, 3)), month(_MONTH_DAY, 1), part(_MONTH_DAY, 2),
                                           *clock(_MONTH_DAY)))
        .when(t.rlike(_YEAR_NAME), _moment(part(_YEAR_NAME, 1), month(_YEAR_NAME, 2), part(_YEAR_NAME, 3), *clock(_YEAR_NAME)))
        .when(t.rlike(_NAME_YEAR), _moment(part(_NAME_YEAR, 2), month(_NAME_YEAR, 1), one, *none))
        .when(t.rlike(_YEAR_MONTH), _moment(part(_YEAR_MONTH, 1), part(_YEAR_MONTH, 2), one, *none))
        .when(t.rlike(_MONTH_YEAR), _moment(part(_MONTH_YEAR, 2), part(_MONTH_YEAR, 1), one, *none))
        .when(t.rlike(_SERIAL), _serial(t.try_cast("double"))))


def period_start(c: Column, period: str) -> Column:
    """First day (DATE) of the day, week (Monday), month, quarter or year holding a moment."""
    if period not in C.PERIODS:
        raise ValueError(f"period must be one of {list(C.PERIODS)}, not {period!r}")
    day = c.cast("date")
    return day if period == "day" else F.trunc(day, period)


def period_label(c: Column, period: str) -> Column:
    """``2026-03-01``, ``Week of 2026-03-02``, ``2026-03``, ``2026-Q1`` or ``2026``; NULL -> ``(no date)``."""
    start = period_start(c, period)
    text = start.cast("string")
    label = {"day": text, "week": F.concat(F.lit("Week of "), text), "month": F.substring(text, 1, 7),
             "quarter": F.concat(F.year(start).cast("string"), F.lit("-Q"), F.quarter(start).cast("string")),
             "year": F.year(start).cast("string")}[period]
    return F.coalesce(label, F.lit(C.NO_DATE))


def period_step(period: str) -> str:
    return {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}[period]


def period_last_day(start: Column, period: str) -> Column:
    return F.date_sub((start + F.expr(f"interval {period_step(period)}")).cast("date"), 1)
