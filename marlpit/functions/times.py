"""Timestamp functions, all in UTC. Numbers are milliseconds since 1970; strings are cast."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of the units with a fixed length.
MILLIS = {"WEEK": 604_800_000, "DAY": 86_400_000, "HOUR": 3_600_000, "MINUTE": 60_000, "SECOND": 1_000, "MILLISECOND": 1}


def to_time(c: Column) -> Column:
    return c.try_cast("timestamp")


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c.cast("long"))


def to_millis(t: Column) -> Column:
    return F.unix_millis(t)


def part(unit: str, t: Column) -> Column:
    """EXTRACT(unit FROM t)."""
    t, unit = to_time(t), unit.lower()
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    jan1 = F.dayofweek(F.date_trunc("year", t))
    simple = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
        "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "isoweek": F.weekofyear, "day_of_week": lambda x: F.weekday(x) + 1,
        "millisecond": lambda _: F.floor(micros / 1_000).cast("int"), "microsecond": lambda _: micros.cast("int"), "nanosecond": lambda _: (micros * 1_000).cast("int"),
        # weeks start on Sunday, and the first holds 1 January
        "week": lambda x: (F.floor((F.dayofyear(x) - 1 + jan1 - 1) / 7) + 1).cast("int"),
    }
    if unit not in simple:
        raise ValueError(f"unknown unit {unit}")
    return simple[unit](t)


UNIT_ORDER = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "NANOSECOND")
DURATION = re.compile(r"(\d+)\s*(YEAR|MONTH|DAY|HOUR|MINUTE|SECOND|MILLISECOND|NANOSECOND)S?", re.IGNORECASE)


def duration(text: str) -> tuple[int, int]:
    """Months and microseconds of '[-](n UNIT)+'."""
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.removeprefix("-").strip()
    if not DURATION.search(body) or DURATION.sub("", body).strip():
        raise ValueError(f"not a duration: {text}")
    months = micros = 0
    for n, unit in DURATION.findall(body):
        unit, n = unit.upper(), int(n)
        if unit in ("YEAR", "MONTH"):
            months += n * (12 if unit == "YEAR" else 1)
        else:
            micros += n // 1_000 if unit == "NANOSECOND" else n * MILLIS[unit] * 1_000
    return sign * months, sign * micros


def timestamp_add(t: Column, text: str) -> Column:
    """Units come from the largest to the smallest."""
    order = [UNIT_ORDER.index(u.upper()) for _, u in DURATION.findall(text)]
    if order != sorted(set(order)):
        raise ValueError(f"units are not in falling order: {text}")
    months, micros = duration(text)
    t = to_time(t)
    moved = F.timestamp_add("MONTH", F.lit(months), t) if months else t
    return F.timestamp_micros(F.unix_micros(moved) + F.lit(micros))


def timestamp_diff(a: Column, b: Column) -> Column:
    """Milliseconds from b to a."""
    return to_millis(to_time(a)) - to_millis(to_time(b))


def get_duration(millis: Column) -> Column:
    """'1 day 6 hours'; no time at all is '0 second'."""
    rest, out = F.abs(millis), []
    for unit in ("DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND"):
        n = F.floor(rest / MILLIS[unit])
        out.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit.lower()}"), F.when(n > 1, "s").otherwise(""))))
        rest = rest - n * MILLIS[unit]
    text = F.concat_ws(" ", *out)
    return F.when(millis.isNull(), None).when(millis == 0, "0 second").otherwise(F.concat(F.when(millis < 0, "-").otherwise(""), text))


#: Units of rounding. iweek and iyear follow the ISO calendar, week starts on Sunday.
UNITS = ("year", "iyear", "quarter", "month", "week", "iweek", "day", "hour", "minute", "second")


def timestamp_floor(t: Column, unit: str = "day") -> Column:
    t, unit = to_time(t), unit.lower()
    if m := re.fullmatch(r"(\d+)\s+(\w+?)s?", unit):
        return timestamp_bucket(t, unit)
    if unit == "week":
        return F.date_trunc("day", t) - F.make_dt_interval(F.dayofweek(t) - 1)
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    if unit == "iyear":
        return _iso_year(F.year(F.date_trunc("week", t) + F.expr("INTERVAL 3 DAYS")))
    return F.date_trunc("week" if unit == "iweek" else unit, t)


def _iso_year(year: Column) -> Column:
    """The Monday of the week that holds 4 January."""
    return F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4)).cast("timestamp"))


def _next(low: Column, unit: str) -> Column:
    if unit.lower() == "iyear":
        return _iso_year(F.year(low + F.expr("INTERVAL 3 DAYS")) + 1)
    months = {"year": 12, "quarter": 3, "month": 1}.get(unit.lower())
    if months:
        return F.timestamp_add("MONTH", F.lit(months), low)
    m = re.fullmatch(r"(?:(\d+)\s+)?i?(\w+?)s?", unit.lower())
    return F.timestamp_millis(F.unix_millis(low) + F.lit(int(m[1] or 1) * MILLIS[m[2].upper()]))


def timestamp_ceil(t: Column, unit: str = "day") -> Column:
    low = timestamp_floor(t, unit)
    return F.when(low == to_time(t), low).otherwise(_next(low, unit))


def timestamp_round(t: Column, unit: str = "day") -> Column:
    """To the nearest boundary; the middle goes up."""
    low = timestamp_floor(t, unit)
    high, now = _next(low, unit), to_time(t)
    return F.when(F.unix_micros(now) - F.unix_micros(low) < F.unix_micros(high) - F.unix_micros(now), low).otherwise(high)


def timestamp_bucket(t: Column, interval: str = "1 day", origin: Column | None = None) -> Column:
    """Start of the bucket of that length; buckets are counted from the origin (1970)."""
    m = re.fullmatch(r"(?:(\d+)\s+)?(week|day|hour|minute|second)s?", interval.strip().lower())
    if not m:
        raise ValueError(f"not an interval: {interval}")
    width = int(m[1] or 1) * MILLIS[m[2].upper()] * 1_000
    at, start = F.unix_micros(to_time(t)), F.unix_micros(origin) if origin is not None else F.lit(0)
    return F.timestamp_micros(at - F.pmod(at - start, F.lit(width)))


def to_last_day_of_month(t: Column) -> Column:
    return F.last_day(to_time(t)).cast("timestamp")


def format_timestamp(t: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss", zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(to_time(t), zone), pattern)


def parse_to_timestamp(s: Column, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern)) if pattern else F.try_to_timestamp(s)


def current_time() -> Column:
    return F.date_trunc("millisecond", F.current_timestamp())


def current_time_millis() -> Column:
    return F.unix_millis(F.current_timestamp())
