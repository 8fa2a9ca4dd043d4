"""Interval rows (start, nullable end) cut to days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeops import TimeLike, day_end, day_lit, day_start, ts
from .spine import UNIT

# How a day takes an interval, and where an open one ends:
STRICT = "strict"  # strict edges, open ends at as_of
LOOSE = "loose"  # both edges count, open ends with the day
LOOSE_NOW = "loose_now"  # both edges count, open ends at as_of


def overlaps_day_strict(on: Column, off: Column, start: Column, end: Column) -> Column:
    """Closed intervals must lie in the period or cross one of its bounds; open ones must start before its end.

    Not plain overlap: touching a bound from outside does not count, and a reversed interval inside does.
    """
    inside = (on >= start) & (off <= end)
    crosses_start = (on < start) & (off > start)
    crosses_end = (on < end) & (off > end)
    still_open = off.isNull() & (on < end)
    return still_open | inside | crosses_start | crosses_end


def overlaps_day_loose(on: Column, off: Column, start: Column, end: Column, as_of: Column) -> Column:
    return (on <= end) & (F.coalesce(off, as_of) >= start)


def _takes(rule: str, on: Column, off: Column, start: Column, end: Column, as_of: Column) -> Column:
    if rule == STRICT:
        return overlaps_day_strict(on, off, start, end)
    return overlaps_day_loose(on, off, start, end, as_of)


def _cut_bounds(rule: str, as_of: Column) -> tuple[Column, Column]:
    """An interval's bounds clamped to its day. GREATEST and LEAST skip NULL."""
    closed = F.col("off_time") if rule == LOOSE else F.coalesce("off_time", as_of)
    day = F.col("day")
    return F.greatest("on_time", day_start(day)), F.least(closed, day_end(day))


def clamp_to_days(df: DataFrame, first: date, last: date, as_of: TimeLike, rule: str) -> DataFrame:
    """Intervals (tml_id, eq_type, eq_no, on_time, off_time) cut to each day in [first, last] they belong to.

    Equal pieces of a unit are merged; `n` says how many there were. An interval left open fills every later day,
    so over many days whole-day pieces are not made one by one: a run of whole days becomes a mark of +1 at its first day
    and one of -1 after its last. Pieces and marks come from one pass over the table and share a shuffle, summed before it.
    """
    now = ts(as_of)
    group = [*UNIT, "day", "on_time", "off_time"]
    if first == last:
        day = day_lit(first)
        taken = df.where(_takes(rule, F.col("on_time"), F.col("off_time"), day_start(day), day_end(day), now))
        on, off = _cut_bounds(rule, now)
        cut = taken.withColumn("day", day).select(*UNIT, "day", on.alias("on_time"), off.alias("off_time"))
        return cut.groupBy(*group).agg(F.count("*").alias("n"))
    changes = _pieces_and_marks(rule, _near_range(rule, df, first, last, now), first, last, now)
    merged = changes.groupBy(*group).agg(F.sum("change").alias("n"), F.max("mark").alias("_mark"))
    # Both kinds must ask for the same columns and rows of the shuffle, else it is made twice: conditions and bounds
    # depend on the aggregates, so that nothing that is asked of the result moves below it.
    is_piece = (F.col("_mark") == 0) & F.col("n").isNotNull()
    bounds = [F.when(is_piece, F.col(c)).alias(c) for c in ("day", "on_time", "off_time")]
    pieces = merged.where(is_piece).select(*UNIT, *bounds, "n")
    return pieces.unionByName(_whole_days(merged.where(F.col("_mark") == 1), last))


def _pieces_and_marks(rule: str, df: DataFrame, first: date, last: date, now: Column) -> DataFrame:
    """Pieces (mark 0) with their bounds, and marks (mark 1) without; a piece that fills its day is a run of one day."""
    _, _, run_from, run_to = _days(rule, now)
    run_from, run_to = F.greatest(run_from, day_lit(first)), F.least(run_to, day_lit(last))

    edges = F.array_distinct(_edge_days(rule, first, last, now))
    # the last two of the days are the run's marks, where there is one; no lambda, so that equal plans compare as equal
    runs = F.when(run_from <= run_to, F.array(run_from, F.date_add(run_to, 1))).otherwise(F.array().cast("array<date>"))
    rows = df.select(*UNIT, "on_time", "off_time", F.size(edges).alias("edges"), F.posexplode(F.concat(edges, runs)).alias("at", "day"))
    after = F.col("at") - F.col("edges")
    rows = rows.select(
        *UNIT, "on_time", "off_time", "day", F.when(after >= 0, 1).otherwise(0).alias("mark"), F.when(after == 1, -1).otherwise(1).alias("change")
    )
    day = F.col("day")
    taken = _takes(rule, F.col("on_time"), F.col("off_time"), day_start(day), day_end(day), now)
    rows = rows.where((F.col("mark") == 1) | (day.between(day_lit(first), day_lit(last)) & taken))
    on, off = _cut_bounds(rule, now)
    rows = rows.select(*UNIT, "day", "change", "mark", on.alias("on_time"), off.alias("off_time"))
    fills = (F.col("mark") == 0) & (F.col("on_time") == day_start(day)) & (F.col("off_time") == day_end(day))
    # its two marks; else the row itself
    rows = rows.withColumn("fills", fills).withColumn("step", F.explode(F.when(fills, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    mark = F.when(F.col("fills"), 1).otherwise(F.col("mark"))
    change = F.when(F.col("step") == 1, -1).otherwise(F.col("change"))
    bounds = [F.when(mark == 0, F.col(c)).alias(c) for c in ("on_time", "off_time")]
    return rows.select(*UNIT, F.date_add("day", F.col("step")).alias("day"), change.alias("change"), mark.alias("mark"), *bounds)


def _near_range(rule: str, df: DataFrame, first: date, last: date, now: Column) -> DataFrame:
    """Drop rows that no day of the range can take; the bounds reach the scan."""
    on, off = F.col("on_time"), F.col("off_time")
    start, end = day_start(day_lit(first)), day_end(day_lit(last))
    touches = (on <= end) & (off.isNull() | (off >= start))
    return df.where(touches | ((on >= start) & (off <= end)) if rule == STRICT else touches)


def _days(rule: str, now: Column) -> tuple[Column, Column, Column, Column]:
    """First day, last day, and the run of days strictly between that the interval fills completely."""
    off = F.col("off_time")
    on_day, off_day = F.to_date("on_time"), F.to_date(F.coalesce(off, now))
    run_end = F.date_sub(off_day, 1)
    if rule == LOOSE:  # an open interval fills the day of as_of too
        run_end = F.when(off.isNull(), off_day).otherwise(run_end)
    return on_day, off_day, F.date_add(on_day, 1), run_end


def _edge_days(rule: str, first: date, last: date, now: Column) -> Column:
    """Candidate days that an interval fills only in part."""
    on_day, off_day, _, _ = _days(rule, now)
    is_open = F.col("off_time").isNull()
    both = F.array(on_day, off_day)
    if rule == LOOSE:
        return F.when(is_open, F.array(on_day)).otherwise(both)
    if rule == STRICT:
        # A reversed interval counts on every day between its bounds, an open one also on days after as_of.
        low, high = F.greatest(off_day, day_lit(first)), F.least(on_day, day_lit(last))
        reversed_days = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<date>"))
        after = F.greatest(F.date_add(off_day, 1), day_lit(first))
        later = F.when(after <= day_lit(last), F.sequence(after, day_lit(last))).otherwise(F.array().cast("array<date>"))
        return (
            F.when(is_open, F.concat(both, later))
            .when(F.col("off_time") < F.col("on_time"), reversed_days)
            .otherwise(both)
        )
    return both


def _whole_days(marks: DataFrame, last: date) -> DataFrame:
    """Days filled from start to end, with how many intervals fill them.

    Marks are summed per unit and day before they come here, so a unit brings at most one row per day to the running sum,
    however many intervals it has.
    """
    by_day = W.partitionBy(*UNIT).orderBy("day")
    runs = marks.select(
        *UNIT,
        "day",
        F.sum("n").over(by_day.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("n"),
        F.coalesce(F.lead("day").over(by_day), day_lit(last + timedelta(days=1))).alias("next_day"),
    )
    days = runs.where((F.col("n") > 0) & (F.col("day") < F.col("next_day"))).select(
        *UNIT, F.explode(F.sequence(F.col("day"), F.date_sub("next_day", 1))).alias("day"), "n"
    )
    bounds = [day_start(F.col("day")).alias("on_time"), day_end(F.col("day")).alias("off_time")]
    return days.select(*UNIT, "day", *bounds, "n")
