"""Joins of intervals with other intervals of the same unit and day, where the pairs are wanted.

Every join carries the hour in its equality key, so a unit's rows are spread over the hours of its days and only rows that
share one are compared. What needs no pairs is in `sweeps`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeops import day_start, hour_number
from .sweeps import FRAME, UNIT_DAY


def hours_touched(start: Column, end: Column) -> Column:
    """The clock hours (as numbers) from that of start to that of end; NULL for a reversed interval."""
    low, high = hour_number(start), hour_number(end)
    return F.when(low <= high, F.sequence(low, high))


def _outer_pieces(outer: DataFrame) -> DataFrame:
    """One row per hour that an interval touches. A reversed one has the hour of its start only."""
    on, off = F.col("on_time"), F.col("off_time")
    hours = F.coalesce(hours_touched(on, off), F.array(hour_number(on)))
    return outer.withColumn("_hour", F.explode_outer(hours))


def _inner_pieces(inner: DataFrame) -> DataFrame:
    """One row at the hour of the start. A reversed interval has one per hour from its end to its start: an interval
    with on <= in and off >= out then lies inside it or overlaps it. No interval of the day starts before the day."""
    low = F.greatest(hour_number(F.col("out_time")), hour_number(day_start(F.col("day"))))
    high = hour_number(F.col("in_time"))
    backwards = (F.col("out_time") < F.col("in_time")) & (low <= high)
    return inner.withColumn("_hour", F.explode(F.when(backwards, F.sequence(low, high)).otherwise(F.array(high))))


def _matches(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of an outer and an inner interval such that on <= in and off >= out; each comes once.

    An inner join: where many intervals share an hour, adaptive execution may split either side.
    """
    o, i = _outer_pieces(outer).alias("o"), _inner_pieces(inner).alias("i")
    on, off, hour = F.col("o.on_time"), F.col("o.off_time"), F.col("o._hour")
    in_, out = F.col("i.in_time"), F.col("i.out_time")
    same = [F.col(f"o.{c}") == F.col(f"i.{c}") for c in (*UNIT_DAY, "_hour")]
    # two spread intervals share several hours: they meet in the first one
    once = (in_ <= out) | (on > off) | (hour == F.greatest(hour_number(on), hour_number(out)))
    extra = [F.col(f"i.{c}") for c in inner.columns if c not in UNIT_DAY]
    return o.join(i, [*same, on <= in_, off >= out, once]).select(*[F.col(f"o.{c}") for c in outer.columns], *extra)


def pieces_with_contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Outer intervals (on_time, off_time) with the inner ones (in_time, out_time) such that on <= in and off >= out.

    Both carry tml_id, eq_type, eq_no, day; either may be reversed. Each match comes once, and besides each outer interval
    has one row without a match: meant to be aggregated per outer interval.
    """
    return _matches(outer, inner).unionByName(outer, allowMissingColumns=True)


def contains_interval(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Left join of outer intervals with the inner ones lying wholly inside, one row per match.

    An interval without a match keeps a row.
    """
    rows = pieces_with_contained(outer, inner).withColumn("_matches", F.count("in_time").over(W.partitionBy(*FRAME)))
    return rows.where(F.col("in_time").isNotNull() | (F.col("_matches") == 0)).drop("_matches")
