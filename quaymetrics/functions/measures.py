"""Small column rules shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeops import HOUR, ceil_minutes, floor_to, micros


def container_length(iso: Column) -> Column:
    """Length class of an ISO size-type code: no code -> NULL, leading '2' -> '20', anything else -> '40'."""
    return F.when(iso.isNull(), F.lit(None).cast("string")).when(F.substring(iso, 1, 1) == "2", "20").otherwise("40")


def whole(x: Column) -> Column:
    """Decimal to whole number by rounding, halves away from zero."""
    return F.round(x).cast("bigint")


def within(t: Column, start: Column, end: Column) -> Column:
    """t when it lies in [start, end], else NULL."""
    return F.when(t.between(start, end), t)


def running_minutes(work_start: Column, work_end: Column, start: Column, end: Column, per_hour: bool = False) -> Column:
    """Minutes of work reached by the end of an hour bucket, counted from the work's own start.

    With per_hour they are counted from the start of the bucket or of the work, whichever is later.
    """
    return running_minutes_us(*(micros(t) for t in (work_start, work_end, start, end)), per_hour)


def running_minutes_us(work_start: Column, work_end: Column, start: Column, end: Column, per_hour: bool = False) -> Column:
    """running_minutes() of instants in microseconds."""
    if per_hour:
        begun, ended = F.greatest(work_start, start), F.least(work_end, end)
        known = work_start.isNotNull() & work_end.isNotNull()
        return F.when(known & (begun <= ended), ceil_minutes(ended - begun))
    started = start >= floor_to(work_start, HOUR)
    return F.when(started & (end < work_end), ceil_minutes(F.abs(end - work_start))).when(
        started & work_end.between(start, end), ceil_minutes(F.abs(work_end - work_start))
    )


def counts_as_json(label: str, name: Column, count: Column, keep: Column) -> Column:
    """Aggregate: JSON array of {label, jobQty} objects for the rows that `keep` marks, sorted by label, NULLs kept.

    One element per distinct label, so the input must already be counted per label.
    """
    item = F.struct(name.alias(label), count.alias("jobQty"))
    return F.to_json(F.sort_array(F.collect_list(F.when(keep, item))), {"ignoreNullFields": "false"})


def is_working() -> Column:
    """Steps of no stated activity count as working."""
    return F.coalesce(F.col("activity_type"), F.lit("Working")) == "Working"


def is_waiting() -> Column:
    return F.col("activity_type") == "Waiting"
