"""Utilisation reports: how much of the available, ignition and login time units work, and their breaks.

Reports answer for one day or for every day of a (first, last) pair, one set of rows per day. Work time is an
envelope: from the first fetch to the last completion, idle gaps included.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import running_minutes, running_minutes_us, within
from ..functions.timeops import (
    HOUR,
    DayLike,
    TimeLike,
    ceil_hours,
    ceil_minutes,
    day_end,
    day_range,
    day_start,
    elapsed,
    floor_to,
    hour_number,
    micros,
    round_minutes,
    span,
)
from ..operators.intervals import contains_interval
from ..operators.sessions import LOOSE, LOOSE_NOW, clamp_to_days
from ..operators.spine import KEYS, UNIT, day_spine, in_days, key_spine, spread, unit_hours
from ..operators.sweeps import FRAME, UNIT_DAY, aggregate_inside, envelope_inside
from ..sources.tables import Scope, Tables, facts, scoped, sessions, sorted_rows

KEY_DAY = [*KEYS, "day"]


def jobs_of_days(tables: Tables, scope: Scope, first, last, *where) -> DataFrame:
    """Jobs completed in the days, with the day they count for."""
    start, end = f"{first} 00:00:00", f"{last} 23:59:59.999"
    jobs = facts(tables, "bi_job_hist", scope, start, end, in_days(F.col("bi_jh_job_cmpl_time"), first, last), *where)
    return jobs.withColumn("day", F.to_date("job_cmpl_time"))


def ignitions(tables: Tables, scope: Scope, first: date | None = None) -> DataFrame:
    return sessions(tables, "bi_eq_ignition", scope, first)


def logins(tables: Tables, scope: Scope, first: date | None = None) -> DataFrame:
    return sessions(tables, "bi_eq_login", scope, first)


def breaks(tables: Tables, scope: Scope, first: date | None = None) -> DataFrame:
    return sessions(tables, "bi_eq_breaktime", scope, first)


# Available time


def _units(tables: Tables, scope: Scope) -> DataFrame:
    kept = F.coalesce(F.col("bi_eq_remove_flag"), F.lit("N")) != "Y"
    return scoped(tables, "bi_eq", scope, kept).select(*UNIT)


def _job_envelopes(tables: Tables, scope: Scope, first, last) -> DataFrame:
    """First fetch (not before the day, and the day's start when none is known) and last completion per unit and day."""
    return (
        jobs_of_days(tables, scope, first, last)
        .groupBy(*UNIT_DAY)
        .agg(F.min("job_fetching_time").alias("_fetch"), F.max("job_cmpl_time").alias("job_end_time"))
        .select(*UNIT_DAY, F.greatest("_fetch", day_start(F.col("day"))).alias("job_start_time"), "job_end_time")
    )


def avail_summary(tables: Tables, day: DayLike, tml_id: str | None = None, eq_type: str | None = None) -> DataFrame:
    scope, (first, last) = Scope(tml_id, eq_type), day_range(day)
    units = _units(tables, scope)
    available = units.groupBy(*KEYS).agg((F.count("eq_no") * 24).alias("_hours"))
    worked = (
        _job_envelopes(tables, scope, first, last)
        .join(units, UNIT)
        .groupBy(*KEY_DAY)
        .agg(ceil_hours(F.sum(elapsed(F.col("job_start_time"), F.col("job_end_time")))).alias("job_performed_hour"))
    )
    rows = day_spine(key_spine(tables, scope), first, last).join(available, KEYS, "left").join(worked, KEY_DAY, "left")
    return rows.select(*KEY_DAY, F.coalesce("_hours", F.lit(0)).alias("available_hour"), "job_performed_hour")


def avail_by_unit(tables: Tables, day: DayLike, tml_id: str | None = None, eq_type: str | None = None) -> DataFrame:
    scope, (first, last) = Scope(tml_id, eq_type), day_range(day)
    unit_days = day_spine(_units(tables, scope), first, last)
    rows = unit_days.join(_job_envelopes(tables, scope, first, last), UNIT_DAY, "left")
    listed = rows.select(
        *UNIT_DAY,
        day_start(F.col("day")).alias("avail_start_time"),
        day_end(F.col("day")).alias("avail_end_time"),
        F.lit(1440).alias("avail_min"),
        "job_start_time",
        "job_end_time",
        ceil_minutes(elapsed(F.col("job_start_time"), F.col("job_end_time"))).alias("job_performed_min"),
    )
    return sorted_rows(listed, scope, *KEY_DAY, "eq_no")


def _work_in_hour(label_start: str, label_end: str, minutes: str, per_hour: bool):
    """Work columns of an hour row with bounds start_time, end_time and an envelope work_start, work_end."""
    bounds = F.col("start_time"), F.col("end_time")
    work = F.col("work_start"), F.col("work_end")
    return [
        within(work[0], *bounds).alias(label_start),
        within(work[1], *bounds).alias(label_end),
        running_minutes(*work, *bounds, per_hour).alias(minutes),
    ]


def avail_hours(
    tables: Tables,
    day: DayLike,
    eq_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
    per_hour: bool = False,
) -> DataFrame:
    """Minutes are counted from the start of work; with per_hour each hour shows its own (so in the other hour lists)."""
    scope, (first, last) = Scope(tml_id, eq_type, eq_no), day_range(day)
    # joined per day and only then spread over the hours, so the join sees one row per unit and day
    rows = day_spine(_units(tables, scope), first, last).join(_job_envelopes(tables, scope, first, last), UNIT_DAY, "left")
    rows = unit_hours(rows.withColumnsRenamed({"job_start_time": "work_start", "job_end_time": "work_end"}))
    work = _work_in_hour("job_start_time", "job_end_time", "job_performed_time_min", per_hour)
    listed = rows.select(*KEY_DAY, "hour_step", "eq_no", "start_time", "end_time", *work)
    return sorted_rows(listed, scope, *KEY_DAY, "eq_no", "hour_step")


# Ignition and login time against work


def _worked_sessions(tables: Tables, cut: DataFrame, scope: Scope, first, last, clamp_fetch: bool = True) -> DataFrame:
    """Distinct sessions of each day with the envelope of the jobs completed inside."""
    fetch = F.col("job_fetching_time")
    fetch = F.greatest(fetch, day_start(F.col("day"))) if clamp_fetch else fetch
    jobs = jobs_of_days(tables, scope, first, last).select(*UNIT_DAY, fetch.alias("fetch"), "job_cmpl_time")
    return aggregate_inside(
        cut, jobs, "job_cmpl_time", {"work_start": ("min", "fetch"), "work_end": ("max", "job_cmpl_time")}
    )


def _session_summary(tables, source, day, as_of, tml_id, eq_type, name: str, clamp_fetch: bool) -> DataFrame:
    scope, (first, last) = Scope(tml_id, eq_type), day_range(day)
    cut = clamp_to_days(source(tables, scope, first), first, last, as_of, LOOSE)
    rows = _worked_sessions(tables, cut, scope, first, last, clamp_fetch)
    totals = rows.groupBy(*KEY_DAY).agg(
        F.sum(ceil_minutes(span(F.col("on_time"), F.col("off_time")))).alias(name),
        F.sum(ceil_minutes(span(F.col("work_start"), F.col("work_end")))).alias("job_performed_time_min"),
    )
    return spread(tables, scope, totals, "day", lambda keys: day_spine(keys, first, last))


def _session_list(tables, source, day, as_of, tml_id, eq_type, labels: tuple[str, str, str], minutes) -> DataFrame:
    scope, (first, last) = Scope(tml_id, eq_type), day_range(day)
    on, off, length = labels
    cut = clamp_to_days(source(tables, scope, first), first, last, as_of, LOOSE)
    return _worked_sessions(tables, cut, scope, first, last).select(
        *UNIT_DAY,
        F.col("on_time").alias(on),
        F.col("off_time").alias(off),
        minutes(span(F.col("on_time"), F.col("off_time"))).alias(length),
        F.col("work_start").alias("job_start_time"),
        F.col("work_end").alias("job_end_time"),
        minutes(span(F.col("work_start"), F.col("work_end"))).alias("job_performed_time_min"),
    )


def _day_spans(cut: DataFrame, *also: Column) -> DataFrame:
    """Per unit and day, from the first session start to the last session end in microseconds, and the hours between."""
    spans = cut.groupBy(*UNIT_DAY).agg(F.min("on_time").alias("_on"), F.max("off_time").alias("_off"), *also)
    spans = spans.withColumns({"first_us": micros(F.col("_on")), "last_us": micros(F.col("_off"))}).drop("_on", "_off")
    return spans.withColumn("gap", ceil_hours(F.abs(F.col("last_us") - F.col("first_us"))).cast("int"))


def _hours_met(start: str, end: str) -> list[Column]:
    """Clock hours of a day with a row from column `start` to `end` in it (_met), and such that one goes on after (_passed).

    Bit h of a number stands for hour h of the day, so a unit's day has one row, however many hours it has. Reversed
    rows meet no hour.
    """
    first = hour_number(day_start(F.col("day")))
    low, high = ((hour_number(F.col(c)) - first).cast("int") for c in (start, end))

    def below(hour: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), hour)

    return [F.bit_or(F.when(low <= high, below(to) - below(low))).alias(name) for to, name in ((high + 1, "_met"), (high, "_passed"))]


def _in_hours(spans: DataFrame, running: DataFrame, start: str, end: str, to_last: bool) -> DataFrame:
    """Left join of the hour rows of unit days (_day_spans() with _hours_met()) with the rows running in their clock hour.

    The first hour row lacks rows whose last hour it is, unless it starts on the clock or they count `to_last`.

    Rows meet their unit's day by an inner join with one row on the other side and are dealt to its hours only then. Hours
    without a row are those whose bit is not set. Times of hours are microseconds, start_us and end_us.
    """
    spans = spans.withColumn("hour_us", floor_to(F.col("first_us"), HOUR))
    begun = F.col("first_us") != F.col("hour_us")
    seq, gap, hour_us = F.col("hour_seq"), F.col("gap"), F.col("hour_us")

    def listed(rows: DataFrame, *extra: str) -> DataFrame:
        low, high = hour_us + (seq - 1) * HOUR, hour_us + seq * HOUR - 1000
        bounds = F.when(seq == 1, F.col("first_us")).otherwise(low), F.when(seq == gap, F.col("last_us")).otherwise(high)
        return rows.select(*UNIT_DAY, "hour_seq", bounds[0].alias("start_us"), bounds[1].alias("end_us"), *extra)

    def number(t: str) -> Column:
        """Which hour row the clock hour of t has."""
        return ((floor_to(micros(F.col(t)), HOUR) - hour_us) / HOUR + 1).cast("int")

    pairs = spans.join(running, UNIT_DAY).withColumns({"_low": number(start), "_high": number(end)})
    low, high = F.greatest("_low", F.lit(1)), F.least("_high", gap)
    some = (F.col("_low") <= F.col("_high")) & (low <= high)
    if not to_last:
        some &= (F.col("_high") > 1) | ~begun
    matches = listed(pairs.withColumn("hour_seq", F.explode(F.when(some, F.sequence(low, high)))), *[c for c in running.columns if c not in UNIT_DAY])

    bits = F.col("_met") if to_last else F.when((seq == 1) & begun, F.col("_passed")).otherwise(F.col("_met"))
    # a span of reversed sessions may go on after its day, where no bit is set
    hours = spans.withColumn("_hour", ((hour_us - micros(day_start(F.col("day")))) / HOUR).cast("int"))
    hours = hours.withColumn("hour_seq", F.explode(F.when(gap >= 1, F.sequence(F.lit(1), gap))))
    met = F.call_function("shiftright", F.coalesce(bits, F.lit(0).cast("bigint")), F.col("_hour") + seq - 1) % 2 == 1
    return matches.unionByName(listed(hours.where(~met)), allowMissingColumns=True)


def _hour_columns(prefix: str, label_start: str, label_end: str, minutes: str, per_hour: bool) -> list[Column]:
    """Bounds and work columns of the rows of _in_hours(), with work_start and work_end and the same in microseconds."""
    start, end, begun, done = (F.col(c) for c in ("start_us", "end_us", "work_start_us", "work_end_us"))
    return [
        F.timestamp_micros(start).cast("timestamp_ntz").alias(f"{prefix}_start_time"),
        F.timestamp_micros(end).cast("timestamp_ntz").alias(f"{prefix}_end_time"),
        F.when(begun.between(start, end), F.col("work_start")).alias(label_start),
        F.when(done.between(start, end), F.col("work_end")).alias(label_end),
        running_minutes_us(begun, done, start, end, per_hour).alias(minutes),
    ]


def _in_micros(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"{c}_us": micros(F.col(c)) for c in ("work_start", "work_end")})


def _session_hours(tables, source, day, eq_no, as_of, tml_id, eq_type, prefix: str, per_hour: bool) -> DataFrame:
    """Hour rows with the sessions running in each hour; an hour may match several sessions.

    A session whose last hour is the clock hour of an unaligned first row does not match that row.
    """
    scope, (first, last) = Scope(tml_id, eq_type, eq_no), day_range(day)
    cut = clamp_to_days(source(tables, scope, first), first, last, as_of, LOOSE)
    running = _in_micros(_worked_sessions(tables, cut, scope, first, last))
    spans = _day_spans(cut, *_hours_met("on_time", "off_time"))
    rows = _in_hours(spans, running, "on_time", "off_time", to_last=False)
    work = _hour_columns(prefix, "job_start_time", "job_end_time", "job_performed_time_min", per_hour)
    return sorted_rows(rows.select(*KEY_DAY, "hour_seq", "eq_no", *work), scope, *KEY_DAY, "eq_no", "hour_seq")


def ignition_summary(
    tables: Tables, day: DayLike, as_of: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    """Here alone a job fetched on an earlier day counts from that fetch."""
    return _session_summary(tables, ignitions, day, as_of, tml_id, eq_type, "ign_time_min", clamp_fetch=False)


def ignition_by_session(
    tables: Tables, day: DayLike, as_of: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    labels = ("ign_start_time", "ign_end_time", "ign_time_min")
    return _session_list(tables, ignitions, day, as_of, tml_id, eq_type, labels, ceil_minutes)


def ignition_hours(
    tables: Tables,
    day: DayLike,
    as_of: TimeLike,
    eq_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
    per_hour: bool = False,
) -> DataFrame:
    return _session_hours(tables, ignitions, day, eq_no, as_of, tml_id, eq_type, "ign", per_hour)


def login_summary(
    tables: Tables, day: DayLike, as_of: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    return _session_summary(tables, logins, day, as_of, tml_id, eq_type, "log_time_min", clamp_fetch=True)


def login_by_session(
    tables: Tables, day: DayLike, as_of: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    """Rounds to the nearest minute where the ignition list rounds up."""
    labels = ("log_in_time", "log_out_time", "log_time_min")
    return _session_list(tables, logins, day, as_of, tml_id, eq_type, labels, round_minutes)


def login_hours(
    tables: Tables,
    day: DayLike,
    as_of: TimeLike,
    eq_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
    per_hour: bool = False,
) -> DataFrame:
    return _session_hours(tables, logins, day, eq_no, as_of, tml_id, eq_type, "log", per_hour)


# Breaks


def _cut_breaks(tables: Tables, scope: Scope, first, last, as_of: TimeLike) -> DataFrame:
    return clamp_to_days(breaks(tables, scope, first), first, last, as_of, LOOSE_NOW).select(
        *UNIT_DAY, F.col("on_time").alias("in_time"), F.col("off_time").alias("out_time"), F.col("n").alias("n_breaks")
    )


def break_summary(
    tables: Tables, day: DayLike, as_of: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    scope, (first, last) = Scope(tml_id, eq_type), day_range(day)
    cut = clamp_to_days(ignitions(tables, scope, first), first, last, as_of, LOOSE).select(*FRAME)
    per_session = envelope_inside(cut, _cut_breaks(tables, scope, first, last, as_of))
    totals = per_session.groupBy(*KEY_DAY).agg(
        F.sum(round_minutes(span(F.col("on_time"), F.col("off_time")))).alias("ign_time_min"),
        F.sum(round_minutes(span(F.col("first_in"), F.col("last_out")))).alias("brk_end_time_min"),
    )
    return spread(tables, scope, totals, "day", lambda keys: day_spine(keys, first, last))


def break_by_session(
    tables: Tables, day: DayLike, as_of: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    """One row per ignition session and break inside it; equal sessions or breaks give as many rows as there are."""
    scope, (first, last) = Scope(tml_id, eq_type), day_range(day)
    cut = clamp_to_days(ignitions(tables, scope, first), first, last, as_of, LOOSE)
    pairs = contains_interval(cut, _cut_breaks(tables, scope, first, last, as_of))
    copies = F.col("n") * F.coalesce(F.col("n_breaks"), F.lit(1))
    rows = pairs.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    return rows.select(
        *UNIT_DAY,
        F.col("on_time").alias("ign_on_time"),
        F.col("off_time").alias("ign_off_time"),
        F.col("in_time").alias("brk_start_time"),
        F.col("out_time").alias("brk_end_time"),
        ceil_minutes(span(F.col("in_time"), F.col("out_time"))).alias("brk_time_min"),
    )


def break_hours(
    tables: Tables,
    day: DayLike,
    as_of: TimeLike,
    eq_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
    per_hour: bool = False,
) -> DataFrame:
    """Hour rows of the ignition span with the breaks running in each clock hour, in whatever session they fall."""
    scope, (first, last) = Scope(tml_id, eq_type, eq_no), day_range(day)
    spans = _day_spans(clamp_to_days(ignitions(tables, scope, first), first, last, as_of, LOOSE))
    found = _cut_breaks(tables, scope, first, last, as_of)
    busy = found.groupBy(*UNIT_DAY).agg(_hours_met("in_time", "out_time")[0])
    spans = spans.unionByName(busy, allowMissingColumns=True).groupBy(*UNIT_DAY)
    spans = spans.agg(*[F.max(c).alias(c) for c in ("first_us", "last_us", "gap", "_met")])
    found = _in_micros(found.withColumns({"work_start": F.col("in_time"), "work_end": F.col("out_time")}))
    rows = _in_hours(spans, found, "in_time", "out_time", to_last=True)
    copies = F.coalesce(F.col("n_breaks"), F.lit(1))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    work = _hour_columns("ign", "brk_start_time", "brk_end_time", "brk_time_min", per_hour)
    return rows.select(*KEY_DAY, "hour_seq", "eq_no", *work)
