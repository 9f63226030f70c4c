"""Times as seconds since 1970 UTC (double, no leap seconds; NULL is unknown), as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A date with dashes or of eight digits, then a time with colons or of six digits; a UTC offset is passed over.
_HOUR, _SIXTY = r"([01]?\d|2[0-4])", r"([0-5]?\d)"
_STAMP = rf"^\s*(?:(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})|(\d{{4}})(\d\d)(\d\d))(?:[T ]\s*(?:{_HOUR}:{_SIXTY}(?::([0-5]?\d(?:\.\d*)?|60))?|([01]\d|2[0-4])([0-5]\d)([0-5]\d(?:\.\d*)?)|\d{{0,5}}))?\s*(?:Z|[+-]\d\d:?\d*)?\s*$"
_SECONDS = {"nanosecond": 1e-9, "microsecond": 1e-6, "millisecond": 1e-3, "second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}
_SHORT = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "sec": 1.0, "secs": 1.0, "min": 60.0, "mins": 60.0, "h": 3600.0, "hr": 3600.0, "hrs": 3600.0, "d": 86400.0}
UNITS = {**_SHORT, **_SECONDS, **{f"{k}s": v for k, v in _SECONDS.items()}}


def days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a civil date; NULL if there is no such date."""
    return F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd"))


def parse(text: Column) -> Column:
    """Seconds of an ISO, compact or date-only text; one-digit months and days are allowed, UTC offsets ignored; others are NULL."""
    part = lambda k: F.nullif(F.regexp_extract(text, _STAMP, k), F.lit(""))
    either = lambda k, other: F.coalesce(part(k), part(other))
    number = lambda k: F.coalesce(either(k, k + 3).try_cast("double"), F.lit(0.0))
    date = days(either(1, 4), either(2, 5), either(3, 6)).cast("double")
    return F.when(date.isNotNull(), date * 86400 + number(7) * 3600 + number(8) * 60 + number(9))


def cf_units(units: str) -> tuple[float, float] | None:
    """(seconds a unit, origin in seconds) of `days since 2020-01-01 00:00:00`; None if it is no time unit (months and years have no fixed length)."""
    m = re.match(r"\s*(\w+)\s+since\s+(.*)", units, re.I)
    origin = parse_text(m[2]) if m else None
    return (UNITS[m[1].lower()], origin) if origin is not None and m[1].lower() in UNITS else None


def parse_text(text: str) -> float | None:
    """parse() of one text, for metadata on the driver."""
    import datetime

    m = re.match(_STAMP, text)
    try:
        date = datetime.date(int(m[1] or m[4]), int(m[2] or m[5]), int(m[3] or m[6]))
    except (TypeError, ValueError):
        return None
    return (date.toordinal() - 719163) * 86400.0 + float(m[7] or m[10] or 0) * 3600 + float(m[8] or m[11] or 0) * 60 + float(m[9] or m[12] or 0)


def cf_decode(value: Column, units: str) -> Column:
    """Seconds of values in CF units; NULL if the units are no time."""
    found = cf_units(units)
    return F.lit(None).cast("double") if found is None else value.cast("double") * F.lit(found[0]) + F.lit(found[1])


def cf(value: Column, units: Column) -> Column:
    """As cf_decode, with units from a column."""
    m = r"(?i)^\s*(\w+)\s+since\s+(.*)$"
    table = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    unit = F.try_element_at(table, F.lower(F.regexp_extract(units, m, 1)))
    return value.cast("double") * unit + parse(F.regexp_extract(units, m, 2))


def text(seconds: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` of the floor of seconds, whatever the session's zone."""
    whole = F.floor(seconds)
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=whole.cast("decimal(18,0)"))
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


_COMPACT = r"(?<![0-9])((?:19|20)\d\d)(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?:[T_]?([01]\d|2[0-3])([0-5]\d)([0-5]\d))?"
_DASHED = r"(?<![0-9])((?:19|20)\d\d)[-_](0[1-9]|1[0-2])[-_](0[1-9]|[12]\d|3[01])"


def in_name(name: Column) -> Column:
    """Seconds of the first date in a file's name: YYYYMMDD with an optional HHMMSS, not after a digit; else YYYY-MM-DD; else NULL."""
    compact = lambda k: F.nullif(F.regexp_extract(name, _COMPACT, k), F.lit(""))
    dashed = lambda k: F.nullif(F.regexp_extract(name, _DASHED, k), F.lit(""))
    clock = lambda k: F.coalesce(compact(k).try_cast("double"), F.lit(0.0))
    one = days(compact(1), compact(2), compact(3)) * F.lit(86400.0) + clock(4) * 3600 + clock(5) * 60 + clock(6)
    return F.coalesce(one, days(dashed(1), dashed(2), dashed(3)) * F.lit(86400.0))


def tick(seconds: Column, span: float) -> Column:
    """An axis label: the day, or the minute if the axis spans less than three days."""
    return F.substring(text(seconds), 1, 10 if span >= 3 * 86400 else 16)


def between_steps(before: Column, after: Column, part: Column) -> Column:
    """The time of a frame between two steps; that of the first where the second is unknown."""
    return F.coalesce(before + (after - before) * part, before)
