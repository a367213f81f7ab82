"""Parts of timestamps, rounding, offsets and ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNIT = {"us": 1, "ms": 1000, "s": 10**6, "min": 60 * 10**6, "h": 3600 * 10**6, "D": 86400 * 10**6}


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _from_micros(c: Column) -> Column:
    return F.timestamp_micros(c.cast("bigint")).cast("timestamp_ntz")


def floor(c: Column, n: int, unit: str) -> Column:
    """To a multiple of n units; units are us, ms, s, min, h and D. The session's zone should be UTC."""
    step = n * _UNIT[unit]
    return _from_micros(F.floor(_micros(c) / step) * step)


def ceil(c: Column, n: int, unit: str) -> Column:
    step = n * _UNIT[unit]
    return _from_micros(F.ceil(_micros(c) / step) * step)


def round_(c: Column, n: int, unit: str) -> Column:
    """To the nearest multiple, halves to the even one."""
    step = n * _UNIT[unit]
    return _from_micros(F.bround(_micros(c) / step, 0) * step)


def parts(c: Column) -> dict[str, Column]:
    return {
        "year": F.year(c), "month": F.month(c), "day": F.day(c), "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c), "quarter": F.quarter(c),
        "dayofyear": F.dayofyear(c), "weekday": F.weekday(c), "days_in_month": F.day(F.last_day(c)), "microsecond": F.pmod(_micros(c), F.lit(10**6)).cast("int"),
        "is_month_start": F.day(c) == 1, "is_month_end": F.to_date(c) == F.last_day(c), "is_year_start": F.dayofyear(c) == 1,
        "is_year_end": (F.month(c) == 12) & (F.day(c) == 31), "is_leap_year": F.day(F.last_day(F.make_date(F.year(c), F.lit(2), F.lit(1)))) == 29,
        "day_name": F.date_format(c, "EEEE"), "month_name": F.date_format(c, "MMMM"), "date": F.to_date(c), "normalize": F.date_trunc("day", c),
    }


def month_end(c: Column, n: int = 1) -> Column:
    """The nth month end after a date; a month end moves on by n whole months."""
    day = F.to_date(c)
    on = day == F.last_day(day)
    return F.last_day(F.add_months(day, F.when(on, n).otherwise(n - 1) if n > 0 else F.lit(n)))


def business_days(c: Column, n: int) -> Column:
    """A date n weekdays later; from a weekend counting starts at the Friday before it."""
    day, at = F.to_date(c), F.weekday(F.to_date(c))
    base = F.date_add(day, -F.greatest(at - 4, F.lit(0)).cast("int"))
    place = F.least(at, F.lit(4)) + n
    return F.date_add(base, (F.floor(place / 5) * 7 + F.pmod(place, F.lit(5)) - F.least(at, F.lit(4))).cast("int"))


def date_range(spark: SparkSession, start: str, end: str, step: str = "1 day") -> DataFrame:
    """Column ts from start to end, both included, by an interval; calendar months and years."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval {step})")).alias("ts"))


def bdate_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    return date_range(spark, start, end).where(F.weekday("ts") < 5)


def resample(df: DataFrame, ts: str, rule: str, made: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates by bucket: a calendar unit (week, month, quarter, year) or an interval such as 5 minutes; empty buckets have no row."""
    bucket = F.date_trunc(rule, ts).cast("timestamp_ntz") if rule in ("week", "month", "quarter", "year", "day", "hour") else F.window(ts, rule)["start"].cast("timestamp_ntz")
    return df.groupBy(*by, bucket.alias("bucket")).agg(*(c.alias(n) for n, c in made.items()))


def asfreq(df: DataFrame, ts: str, step: str, cols: Sequence[str]) -> DataFrame:
    """The rows at the points of a regular grid from the first to the last time; null where there is none."""
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    grid = ends.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(ts))
    return grid.join(df.select(ts, *cols), ts, "left")


def between_time(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows with a time of day from start to end, both included; over midnight if start is later."""
    at = F.date_format(ts, "HH:mm:ss")
    inside = (at >= start) & (at <= end) if start <= end else (at >= start) | (at <= end)
    return df.where(inside)


def tz_localize(c: Column, zone: str) -> Column:
    """A clock time of a zone as UTC."""
    return F.to_utc_timestamp(c.cast("timestamp"), zone).cast("timestamp_ntz")


def tz_convert(c: Column, zone: str) -> Column:
    """A UTC time as the clock time of a zone."""
    return F.from_utc_timestamp(c.cast("timestamp"), zone).cast("timestamp_ntz")


def total_seconds(a: Column, b: Column) -> Column:
    """Seconds from b to a."""
    return (_micros(a) - _micros(b)) / 1e6


def components(seconds: Column) -> dict[str, Column]:
    """Whole days, hours, minutes and seconds of a length of time; days carry the sign."""
    whole = F.floor(seconds)
    rest = F.pmod(whole, F.lit(86400))
    return {"days": F.floor(whole / 86400), "hours": F.floor(rest / 3600), "minutes": F.floor(F.pmod(rest, F.lit(3600)) / 60), "seconds": F.pmod(rest, F.lit(60))}


def to_timedelta(c: Column) -> Column:
    """Seconds of a text such as 2 days 03:04:05, 03:04:05 or 5 days; null for others."""
    days = F.regexp_extract(c, r"^\s*(-?\d+) days?", 1)
    clock = F.regexp_extract(c, r"(\d+):(\d\d):(\d\d)\s*$", 0)
    part = lambda i: F.get(F.split(clock, ":"), F.lit(i)).cast("double")
    known = c.rlike(r"^\s*(-?\d+ days?)?\s*(\d+:\d\d:\d\d)?\s*$") & c.rlike(r"\d")
    return F.when(known, F.when(days != "", days.cast("double") * 86400).otherwise(0.0) + F.when(clock != "", part(0) * 3600 + part(1) * 60 + part(2)).otherwise(0.0))


def timedelta_range(spark: SparkSession, start: int, count: int, step: int) -> DataFrame:
    """Column seconds: so many lengths of time, a step of seconds apart."""
    return spark.range(count).select((F.lit(start) + F.col("id") * step).alias("seconds"))


def period_range(spark: SparkSession, start: str, end: str, freq: str = "month") -> DataFrame:
    """Column period with the starts of all months (days, quarters, years) from start to end."""
    step = {"day": "1 day", "month": "1 month", "quarter": "3 months", "year": "1 year"}[freq]
    return date_range(spark, start, end, step).select(F.date_trunc(freq, "ts").cast("timestamp_ntz").alias("period"))


def infer_freq(df: DataFrame, ts: str) -> DataFrame:
    """One row, seconds: the one distance between neighbouring different times, null if there are several."""
    from lariat.operators.order import over

    times = df.select(ts).where(F.col(ts).isNotNull()).distinct()
    steps = over(times, {"__d": lambda w: total_seconds(F.col(ts), F.lag(ts).over(w))}, [ts], before=1)
    return steps.agg(F.when(F.min("__d") == F.max("__d"), F.min("__d")).alias("seconds"))


def day(c: Column, n: int = 1) -> Column:
    return F.date_add(F.to_date(c), n)


def month_start(c: Column, n: int = 1) -> Column:
    """The nth first of a month after a date; for n below 0, before it."""
    first = F.trunc(c, "month")
    return F.add_months(first, n) if n > 0 else F.add_months(first, F.when(F.to_date(c) == first, n).otherwise(n + 1))


def year_start(c: Column, n: int = 1) -> Column:
    first = F.trunc(c, "year")
    return F.add_months(first, 12 * n) if n > 0 else F.add_months(first, F.when(F.to_date(c) == first, 12 * n).otherwise(12 * (n + 1)))


def year_end(c: Column, n: int = 1) -> Column:
    """The nth last day of a year after a date; that day itself moves on by n whole years."""
    last = F.last_day(F.add_months(F.trunc(c, "year"), 11))
    return F.add_months(last, F.when(F.to_date(c) == last, 12 * n).otherwise(12 * (n - 1) if n > 0 else 12 * n))


def date_offset(c: Column, years: int = 0, months: int = 0, days: int = 0) -> Column:
    """Months first, to the last day at most, then days."""
    return F.date_add(F.add_months(F.to_date(c), 12 * years + months), days)
