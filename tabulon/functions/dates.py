"""Dates: the Solar Hijri calendar, quota days, dates in text, times to live."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of the Solar Hijri calendar.
MONTHS = ("فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def jalali(d: Column) -> Column:
    """DT1: struct(year, month, day) of a date. Counts days from 1 Farvardin 1375 in cycles of 33 years (12053 days):
    eight groups of four years (1461 days), of which the first is leap, and one more year."""
    n = F.datediff(d, F.lit("1996-03-20").cast("date"))  # 1 Farvardin 1375, the first year of a 33-year cycle
    cycle, n = _div(n, 12053), F.pmod(n, F.lit(12053))
    group, n = _div(n, 1461), F.pmod(n, F.lit(1461))
    year = F.when(n < 366, 0).otherwise(_div(n - 366, 365) + 1)
    day = F.when(n < 366, n).otherwise(F.pmod(n - 366, F.lit(365)))
    month = F.when(day < 186, _div(day, 31) + 1).otherwise(_div(day - 186, 30) + 7)
    in_month = F.when(day < 186, F.pmod(day, F.lit(31))).otherwise(F.pmod(day - 186, F.lit(30))) + 1
    return F.struct((cycle * 33 + group * 4 + year + 1375).cast("int").alias("year"), month.cast("int").alias("month"), in_month.cast("int").alias("day"))


def jalali_text(j: Column) -> Column:
    return F.concat_ws("/", j["year"].cast("string"), F.lpad(j["month"].cast("string"), 2, "0"), F.lpad(j["day"].cast("string"), 2, "0"))


def quota_day(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """DT2: the day a request counts for, from a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def next_reset(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """DT2: when the next quota day starts, in UTC."""
    return F.to_utc_timestamp(F.date_add(quota_day(ts, zone), 1).cast("timestamp"), zone)


_D = "[0-9۰-۹]"
_MONTH = "(?<![\\u0600-\\u06ff])(" + "|".join(MONTHS) + ")(?![\\u0600-\\u06ff])"


def has_date(c: Column) -> Column:
    """DT3: a numeric date, or a month's name with a day, a year or the word month."""
    number = rf"{_D}{{2,4}}\s*[/\-.]\s*{_D}{{1,2}}\s*[/\-.]\s*{_D}{{1,4}}"
    return c.rlike(f"{number}|{_D}{{1,2}}\\s*{_MONTH}|{_MONTH}\\s*(ماه)?\\s*{_D}{{2,4}}|{_MONTH}\\s*ماه")


def expired(created: Column, now: Column, minutes: int) -> Column:
    """DT4, FI14: older than its time to live."""
    return (now.cast("timestamp").cast("long") - created.cast("timestamp").cast("long")) > minutes * 60
