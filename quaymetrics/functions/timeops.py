"""Time arithmetic on zone-less timestamps, exact in whole microseconds.

Periods end one millisecond before the next one starts and both bounds are inclusive, so the last
999 microseconds of an hour or a day belong to no bucket.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY_LAST = timedelta(days=1) - timedelta(milliseconds=1)

TimeLike = datetime | date | str
DayLike = date | str | tuple["date | str", "date | str"]


def as_datetime(value: TimeLike) -> datetime:
    if isinstance(value, str):
        return datetime.fromisoformat(value)
    if isinstance(value, datetime):
        return value
    return datetime(value.year, value.month, value.day)


def ts(value: TimeLike) -> Column:
    """A zone-less timestamp literal."""
    return F.expr(f"timestamp_ntz'{as_datetime(value).isoformat(sep=' ')}'")


def day_range(day: DayLike) -> tuple[date, date]:
    """One day, or an inclusive (first, last) pair of days."""
    first, last = day if isinstance(day, tuple) else (day, day)
    first, last = as_datetime(first).date(), as_datetime(last).date()
    if last < first:
        raise ValueError(f"last day {last} lies before first day {first}")
    return first, last


def day_lit(value: date) -> Column:
    return F.expr(f"date'{value.isoformat()}'")


def day_start(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def day_end(day: Column) -> Column:
    return day_start(day) + F.expr("interval '23:59:59.999' hour to second")


def hour_floor(t: Column) -> Column:
    """Start of the clock hour of t. Plain arithmetic: date_trunc would go through a zoned timestamp and the calendar."""
    return F.timestamp_micros(floor_to(micros(t), HOUR)).cast("timestamp_ntz")


def hour_end(hour: Column) -> Column:
    return hour + F.expr("interval '59:59.999' minute to second")


def plus_hours(t: Column, n: Column | int) -> Column:
    return t + F.make_dt_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def hour_key(t: Column) -> Column:
    return F.date_format(t, "yyyyMMddHH")


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def elapsed(start: Column, end: Column) -> Column:
    """Microseconds from start to end."""
    return micros(end) - micros(start)


def span(start: Column, end: Column) -> Column:
    """Absolute microseconds between two instants."""
    return F.abs(elapsed(start, end))


def _divide(x: Column, unit: int) -> Column:
    """Whole-number division towards zero; stays in longs."""
    return F.call_function("div", x, F.lit(unit).cast("bigint"))


def floor_to(us: Column, unit: int) -> Column:
    """The multiple of unit at or below us."""
    return us - F.pmod(us, F.lit(unit).cast("bigint"))


def ceil_to(us: Column, unit: int) -> Column:
    """The multiple of unit at or above us."""
    return us + F.pmod(-us, F.lit(unit).cast("bigint"))


def hour_number(t: Column) -> Column:
    """Clock hours since 1970: a cheap join key for the hour of t."""
    return _divide(floor_to(micros(t), HOUR), HOUR)


def ceil_minutes(us: Column) -> Column:
    return _divide(ceil_to(us, MINUTE), MINUTE)


def ceil_hours(us: Column) -> Column:
    return _divide(ceil_to(us, HOUR), HOUR)


def round_minutes(us: Column) -> Column:
    """Nearest minute, halves away from zero."""
    half = MINUTE // 2
    return F.when(us >= 0, _divide(us + half, MINUTE)).otherwise(-_divide(half - us, MINUTE))
