"""Generated time axes. Every spine hangs off a key table, so one job answers all terminals and equipment types."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import (
    TimeLike,
    as_datetime,
    day_end,
    day_lit,
    day_start,
    hour_end,
    hour_floor,
    hour_key,
    plus_hours,
    ts,
)
from ..sources.tables import Scope, Tables, scoped

KEYS = ["tml_id", "eq_type"]
UNIT = [*KEYS, "eq_no"]


def key_spine(tables: Tables, scope: Scope, *others: DataFrame) -> DataFrame:
    """Every (terminal, equipment type) that must get a row: the one asked for, or all registered or seen in `others`."""
    if scope.single_key:
        one = tables.bi_eq.sparkSession.range(1)
        return one.select(F.lit(scope.tml_id).alias("tml_id"), F.lit(scope.eq_type).alias("eq_type"))
    keys = scoped(tables, "bi_eq", Scope(scope.tml_id, scope.eq_type)).select(*KEYS).distinct()
    for other in others:
        keys = keys.unionByName(other.select(*KEYS).distinct())
    return keys.distinct() if others else keys


def spread(
    tables: Tables,
    scope: Scope,
    seen: DataFrame,
    axis: str,
    spine: Callable[[DataFrame], DataFrame],
    totals: tuple[str, ...] = (),
    registered: bool = True,
) -> DataFrame:
    """Spine rows of every key that is registered or seen, with the values that `seen` has for a key and `axis` value.

    `seen` has one row per key and value of `axis` (a column of the spine too); a row without one makes its key known, no
    more. Keys and values thus come from one evaluation of the facts: the few rows of a key, at most one per step of its
    spine and one besides, are gathered in a map that its spine rows look up. Columns named in `totals` are summed per key.
    Without `registered` only a single key asked for is added to those seen.
    """
    values = [c for c in seen.columns if c not in (*KEYS, axis, *totals)]
    entry = F.when(F.col(axis).isNotNull(), F.struct(F.col(axis), F.struct(*values)))
    rows = seen.select(*KEYS, entry.alias("_entry"), *totals)
    if registered or scope.single_key:
        rows = rows.unionByName(key_spine(tables, scope), allowMissingColumns=True)
    at = F.map_from_entries(F.collect_list("_entry")).alias("_at")
    steps = spine(rows.groupBy(*KEYS).agg(at, *[F.sum(c).alias(c) for c in totals]))
    found = F.try_element_at("_at", F.col(axis))
    return steps.select(*[c for c in steps.columns if c != "_at"], *[found[v].alias(v) for v in values])


def rolling_window(now: TimeLike, hours: int):
    """Bounds of the facts a rolling report reads: the last `hours` hours up to `now`, both inclusive."""
    now = as_datetime(now)
    return now - timedelta(hours=hours), now


def _first_hour(now: TimeLike, hours: int):
    return as_datetime(now).replace(minute=0, second=0, microsecond=0) - timedelta(hours=hours - 1)


def hour_spine(keys: DataFrame, now: TimeLike, hours: int = 6) -> DataFrame:
    """Hour buckets ending in the running hour of `now`; the running one ends at `now` itself."""
    now = as_datetime(now)
    running = ts(_first_hour(now, 1))
    start = F.explode(F.sequence(ts(_first_hour(now, hours)), running, F.expr("interval 1 hour")))
    rows = keys.withColumn("s_time", start)
    end = F.when(F.col("s_time") == running, ts(now)).otherwise(hour_end(F.col("s_time")))
    return rows.withColumn("e_time", end).withColumn("hour_step", hour_key(F.col("s_time")))


def bucket_end(t: Column, now: TimeLike) -> Column:
    """End of the spine bucket that the hour of t starts."""
    hour = hour_floor(t)
    return F.when(hour == ts(_first_hour(now, 1)), ts(now)).otherwise(hour_end(hour))


def in_bucket(t: Column, now: TimeLike, hours: int = 6) -> Column:
    """Whether some bucket of the spine holds t; the millisecond gap at the end of an hour belongs to none."""
    return (t >= ts(_first_hour(now, hours))) & (t <= ts(now)) & (t <= bucket_end(t, now))


def onto_hours(tables: Tables, scope: Scope, hourly: DataFrame, now: TimeLike, hours: int) -> DataFrame:
    """Hour buckets with the hourly aggregates (keyed by tml_id, eq_type, s_time); hours without facts stay NULL."""
    return spread(tables, scope, hourly, "s_time", lambda keys: hour_spine(keys, now, hours))


def day_column(first: date, last: date) -> Column:
    return F.explode(F.sequence(day_lit(first), day_lit(last)))


def day_spine(keys: DataFrame, first: date, last: date) -> DataFrame:
    return keys.select("*", day_column(first, last).alias("day"))


def in_days(t: Column, first: date, last: date) -> Column:
    """Whether t lies in one of the days, each ending a millisecond early."""
    bounds = (t >= day_start(day_lit(first))) & (t <= day_end(day_lit(last)))
    return bounds if first == last else bounds & (t <= day_end(F.to_date(t)))


def unit_hours(unit_days: DataFrame) -> DataFrame:
    """24 hour buckets for each unit and day."""
    rows = unit_days.withColumn("hour_step", F.explode(F.sequence(F.lit(1), F.lit(24))))
    start = plus_hours(day_start(F.col("day")), F.col("hour_step") - 1)
    return rows.withColumn("start_time", start).withColumn("end_time", hour_end(F.col("start_time")))


def span_hours(spans: DataFrame, gap: Column, start: Column, end: Column) -> DataFrame:
    """`gap` hour buckets per row: the first starts at `start`, the last ends at `end`, the others lie on the clock.

    A missing or zero gap gives no rows.
    """
    rows = spans.withColumn("gap", gap.cast("int"))
    rows = rows.withColumn("hour_seq", F.explode(F.when(F.col("gap") >= 1, F.sequence(F.lit(1), F.col("gap")))))
    seq = F.col("hour_seq")
    s = F.when(seq == 1, start).otherwise(hour_floor(plus_hours(start, seq - 1)))
    e = F.when(seq == F.col("gap"), end).otherwise(hour_floor(plus_hours(start, seq)) - F.expr("interval 1 millisecond"))
    return rows.withColumn("start_time", s).withColumn("end_time", e)
