"""Execution reports: travel efficiency, job cycle time, laden distance, fuel, work with and without a job.

Rolling reports answer for the last `hours` clock hours up to `now`, one row per hour. Range reports answer for
facts completed in [start, end]. Every report keeps tml_id and eq_type and covers all of them unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import is_waiting, is_working, whole
from ..functions.timeops import TimeLike, hour_floor
from ..operators.seq import numbered
from ..operators.spine import KEYS, UNIT, bucket_end, in_bucket, onto_hours, rolling_window
from ..operators.steps import explode_legs, explode_steps
from ..sources.tables import Scope, Tables, facts, scoped, sorted_rows, trips

HOUR_COLUMNS = [*KEYS, "s_time", "e_time", "hour_step"]
TIME_FIELDS = ["interval_sec", "activity_type"]
LADEN_FIELDS = ["step_dist", "laden_status"]
LEG_VALUES = ["eta_distance", "ata_distance", "eta_time_sec", "ata_time_sec"]


def _zero_where_absent(*columns: str) -> list[Column]:
    """0 for hours without any fact; a NULL sum over facts stays NULL."""
    return [F.when(F.col("_rows").isNull(), F.lit(0)).otherwise(F.col(c)).alias(c) for c in columns]


def _hourly(df: DataFrame, t: Column, counts: Column, *aggregates: Column) -> DataFrame:
    """Sums per key and hour of t. Rows that don't count fall under no hour; their keys are still known from them."""
    return df.groupBy(*KEYS, F.when(counts, hour_floor(t)).alias("s_time")).agg(*aggregates, F.count("*").alias("_rows"))


def _sum_when(condition: Column, value: Column | str, name: str) -> Column:
    return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value).otherwise(F.lit(0))).alias(name)


# Travel efficiency: estimated against actual legs


def _leg_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in LEG_VALUES]


def travel_eff_hourly(
    tables: Tables, now: TimeLike, tml_id: str | None = None, eq_type: str | None = None, hours: int = 6
) -> DataFrame:
    scope = Scope(tml_id, eq_type)
    jobs = facts(tables, "bi_job_hist", scope, *rolling_window(now, hours), F.col("bi_jh_trv_with_eta").isNotNull())
    done = F.col("job_cmpl_time")
    legs = explode_legs(jobs.select(*KEYS, "job_cmpl_time", "trv_with_eta"), outer=True)
    hourly = _hourly(legs, done, F.col("leg_no").isNotNull() & in_bucket(done, now, hours), *_leg_sums())
    rows = onto_hours(tables, scope, hourly, now, hours).select(*HOUR_COLUMNS, *LEG_VALUES)
    return sorted_rows(rows, scope, *KEYS, "s_time")


def travel_eff_by_job(
    tables: Tables, start: TimeLike, end: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    jobs = facts(tables, "bi_job_hist", Scope(tml_id, eq_type), start, end, F.col("bi_jh_trv_with_eta").isNotNull())
    group = [*UNIT, "job_id", "cntr_no"]
    return explode_legs(jobs.select(*group, "trv_with_eta")).groupBy(*group).agg(*_leg_sums())


def travel_eff_legs(
    tables: Tables,
    job_id: str | None = None,
    cntr_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
    by_container: bool = True,
) -> DataFrame:
    """Legs of a job, numbered. With `by_container` a call is for one job and container, otherwise for one job.

    Without job_id every job is listed, each with its own numbering.
    """
    asked = {"job_id": job_id, "cntr_no": cntr_no} if by_container else {"job_id": job_id}
    chosen = [
        F.col(f"bi_jh_{c}").isNotNull() if wanted is None else F.col(f"bi_jh_{c}") == wanted for c, wanted in asked.items()
    ]
    jobs = scoped(tables, "bi_job_hist", Scope(tml_id, eq_type), F.col("bi_jh_trv_with_eta").isNotNull(), *chosen)
    call = [*KEYS, *asked]
    kept = [*dict.fromkeys([*UNIT, "job_id", "cntr_no", "job_cmpl_time", "user_id", "trv_with_eta"])]
    legs = explode_legs(jobs.select(*kept))
    order = ["eq_no", "job_cmpl_time", "cntr_no", "user_id", "leg_no", "from_step", "to_step", *LEG_VALUES]
    rows = numbered(legs, call, order, "r_seq")
    return rows.select(
        *KEYS,
        "job_id",
        "r_seq",
        "cntr_no",
        "eq_no",
        "from_step",
        "to_step",
        "user_id",
        *LEG_VALUES,
        (F.col("ata_time_sec") - F.col("eta_time_sec")).alias("trv_efc_time"),
        (F.col("ata_distance") - F.col("eta_distance")).alias("trv_efc_distance"),
    )


# Distance travelled, with and without a job


def travel_with_job_hourly(
    tables: Tables, now: TimeLike, tml_id: str | None = None, eq_type: str | None = None, hours: int = 6
) -> DataFrame:
    """Trips count in the hour they end, transactions in the hour of their last completion."""
    scope, window = Scope(tml_id, eq_type), rolling_window(now, hours)
    travel = trips(tables, scope, *window)
    work = facts(tables, "bi_eq_tran", scope, *window)
    by_end = travel.select(*KEYS, hour_floor(F.col("trv_etime")).alias("s_time"), F.col("dist").alias("trv_dist"))
    by_completion = work.select(*KEYS, hour_floor(F.col("last_job_cmpl_time")).alias("s_time"), F.col("trv_dist").alias("trv_job_dist"))
    both = by_end.unionByName(by_completion, allowMissingColumns=True)
    sums = [F.sum(c).alias(c) for c in ("trv_dist", "trv_job_dist")]
    rows = onto_hours(tables, scope, both.groupBy(*KEYS, "s_time").agg(*sums), now, hours)
    return rows.select(*HOUR_COLUMNS, *[whole(F.col(c)).alias(c) for c in ("trv_dist", "trv_job_dist")])


def travel_with_job_by_unit(
    tables: Tables, start: TimeLike, end: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    """The total is rounded, the job part is not, and their difference mixes the two."""
    scope = Scope(tml_id, eq_type)
    total = trips(tables, scope, start, end).groupBy(*UNIT).agg(whole(F.sum("dist")).alias("total_dist"))
    job = facts(tables, "bi_eq_tran", scope, start, end).groupBy(*UNIT).agg(F.sum("trv_dist").alias("job_dist"))
    without = (F.col("total_dist") - F.coalesce(F.col("job_dist"), F.lit(0))).alias("no_job_dist")
    rows = total.join(job, UNIT, "left").select(*UNIT, "total_dist", "job_dist", without)
    return sorted_rows(rows, scope, *UNIT)


def travel_with_job_rows(
    tables: Tables,
    start: TimeLike,
    end: TimeLike,
    eq_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
) -> DataFrame:
    group = ["job_cmpl_time", "cntr_no", "eq_no", "job_type", "from_loc", "to_loc", "user_id", "eq_tran_id"]
    scope, dist = Scope(tml_id, eq_type, eq_no), F.sum(whole(F.col("step_dist"))).alias("dist")
    rows = _job_rows(tables, scope, start, end, group, ["step_dist"], dist)
    out = ["job_cmpl_time", "cntr_no", "eq_no", "job_type", "from_loc", "to_loc", "dist", "user_id", "eq_tran_id"]
    ordered = numbered(rows, UNIT, [*group, "dist"], "r_seq", hour_floor(F.col("job_cmpl_time")))
    return sorted_rows(ordered.select(*KEYS, "r_seq", *out), scope, *UNIT, "r_seq")


def _job_rows(
    tables: Tables,
    scope: Scope,
    start: TimeLike,
    end: TimeLike,
    group: list[str],
    fields: list[str],
    *aggregates: Column,
) -> DataFrame:
    """Cycle steps of jobs completed in the range, summed per group."""
    jobs = facts(tables, "bi_job_hist", scope, start, end, F.col("bi_jh_job_cycle_step").isNotNull())
    steps = explode_steps(jobs.select(*KEYS, *group, "job_cycle_step"), "job_cycle_step", *fields)
    return steps.groupBy(*KEYS, *group).agg(*aggregates)


# Job cycle time


def cycle_time_hourly(
    tables: Tables, now: TimeLike, tml_id: str | None = None, eq_type: str | None = None, hours: int = 6
) -> DataFrame:
    """An hour without steps has NULL working but 0 waiting seconds."""
    scope = Scope(tml_id, eq_type)
    jobs = facts(tables, "bi_job_hist", scope, *rolling_window(now, hours), F.col("bi_jh_job_id").isNotNull())
    done = F.col("job_cmpl_time")
    steps = explode_steps(jobs.select(*KEYS, "job_cmpl_time", "job_cycle_step"), "job_cycle_step", *TIME_FIELDS, outer=True)
    seconds = whole(F.col("interval_sec"))
    hourly = _hourly(
        steps,
        done,
        F.col("step_no").isNotNull() & in_bucket(done, now, hours),
        _sum_when(is_working(), seconds, "working_time_sec"),
        _sum_when(is_waiting(), seconds, "waiting_time_sec"),
    )
    rows = onto_hours(tables, scope, hourly, now, hours)
    return rows.select(*HOUR_COLUMNS, "working_time_sec", *_zero_where_absent("waiting_time_sec"))


def cycle_time_by_job(
    tables: Tables, start: TimeLike, end: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    jobs = facts(tables, "bi_job_hist", Scope(tml_id, eq_type), start, end, F.col("bi_jh_job_id").isNotNull())
    group = [*KEYS, "job_id", "cntr_no", "job_cmpl_time"]
    seconds = whole(F.col("interval_sec"))
    return (
        explode_steps(jobs.select(*group, "job_cycle_step"), "job_cycle_step", *TIME_FIELDS)
        .groupBy(*group)
        .agg(
            _sum_when(is_working(), seconds, "working_time"),
            _sum_when(is_waiting(), seconds, "waiting_time"),
            F.sum(seconds).alias("total_time"),
        )
    )


def cycle_time_legs(
    tables: Tables, job_id: str | None = None, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    return travel_eff_legs(tables, job_id, None, tml_id, eq_type, by_container=False)


# Laden and unladen distance


def _laden(distance: Column) -> list[Column]:
    status = F.col("laden_status")
    return [_sum_when(status == "L", distance, "laden_dist"), _sum_when(status == "U", distance, "unladen_dist")]


def laden_hourly(
    tables: Tables, now: TimeLike, tml_id: str | None = None, eq_type: str | None = None, hours: int = 6
) -> DataFrame:
    """From transactions; distances are not rounded here."""
    scope = Scope(tml_id, eq_type)
    work = facts(tables, "bi_eq_tran", scope, *rolling_window(now, hours), F.col("bi_et_event_step").isNotNull())
    done = F.col("last_job_cmpl_time")
    steps = explode_steps(work.select(*KEYS, "last_job_cmpl_time", "event_step"), "event_step", *LADEN_FIELDS, outer=True)
    hourly = _hourly(steps, done, F.col("step_no").isNotNull() & in_bucket(done, now, hours), *_laden(F.col("step_dist")))
    rows = onto_hours(tables, scope, hourly, now, hours)
    return rows.select(*HOUR_COLUMNS, *_zero_where_absent("laden_dist", "unladen_dist"))


def laden_by_unit(
    tables: Tables, start: TimeLike, end: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    """From transactions; each distance is rounded to a whole number first."""
    work = facts(tables, "bi_eq_tran", Scope(tml_id, eq_type), start, end, F.col("bi_et_event_step").isNotNull())
    distance = whole(F.col("step_dist"))
    steps = explode_steps(work.select(*UNIT, "event_step"), "event_step", *LADEN_FIELDS)
    return steps.groupBy(*UNIT).agg(*_laden(distance), F.sum(distance).alias("total_dist"))


def laden_rows(
    tables: Tables,
    start: TimeLike,
    end: TimeLike,
    eq_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
) -> DataFrame:
    """From job history, not transactions."""
    group = ["job_cmpl_time", "cntr_no", "eq_no", "job_type", "user_id"]
    distance = whole(F.col("step_dist"))
    sums = [*_laden(distance), F.sum(distance).alias("total_dist")]
    rows = _job_rows(tables, Scope(tml_id, eq_type, eq_no), start, end, group, LADEN_FIELDS, *sums)
    out = ["job_cmpl_time", "cntr_no", "eq_no", "job_type", "laden_dist", "unladen_dist", "total_dist", "user_id"]
    return numbered(rows, UNIT, group, "r_seq", hour_floor(F.col("job_cmpl_time"))).select(*KEYS, "r_seq", *out)


# Fuel


def fuel_hourly(
    tables: Tables, now: TimeLike, tml_id: str | None = None, eq_type: str | None = None, hours: int = 6
) -> DataFrame:
    """Only trips that lie wholly inside one hour bucket count."""
    scope = Scope(tml_id, eq_type)
    travel = trips(tables, scope, *rolling_window(now, hours))
    begun, ended = F.col("trv_stime"), F.col("trv_etime")
    inside = in_bucket(begun, now, hours) & (hour_floor(begun) == hour_floor(ended)) & (ended <= bucket_end(begun, now))
    hourly = _hourly(travel, begun, inside, F.sum(F.coalesce(F.col("fuel"), F.lit(0))).alias("fuel"))
    return onto_hours(tables, scope, hourly, now, hours).select(*HOUR_COLUMNS, *_zero_where_absent("fuel"))


def fuel_by_unit(
    tables: Tables, start: TimeLike, end: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    scope = Scope(tml_id, eq_type)
    fuel = F.sum(F.coalesce(F.col("fuel"), F.lit(0))).alias("fuel_cons")
    used = trips(tables, scope, start, end).groupBy(*UNIT).agg(fuel)
    job = facts(tables, "bi_eq_tran", scope, start, end).groupBy(*UNIT).agg(F.sum("fuel").alias("job_fuel"))
    return used.join(job, UNIT, "left").select(*UNIT, "fuel_cons", "job_fuel")


def fuel_rows(
    tables: Tables,
    start: TimeLike,
    end: TimeLike,
    eq_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
) -> DataFrame:
    """Jobs that look alike in these columns merge, and their fuel is shown once."""
    group = ["eq_no", "cntr_no", "job_type", "fuel", "user_id"]  # eq_no is the unit's own: cntr_no leads the order
    # by leading characters (owner and first digits of a container), so that no count runs over all containers of a unit
    buckets = [F.substring("cntr_no", 1, n) for n in (6, 9)]
    scope, dist = Scope(tml_id, eq_type, eq_no), F.sum(whole(F.col("step_dist"))).alias("trv_dist")
    rows = _job_rows(tables, scope, start, end, group, ["step_dist"], dist)
    out = ["eq_no", "cntr_no", "job_type", "trv_dist", "fuel", "user_id"]
    return numbered(rows, UNIT, group[1:], "r_seq", *buckets, F.col("cntr_no")).select(*KEYS, "r_seq", *out)


# Work with and without a job


def _job_counts() -> list[Column]:
    job = F.col("job_id")
    return [
        F.sum(F.when(job.isNotNull(), 1).otherwise(0)).alias("with_job_count"),
        F.sum(F.when(job.isNull(), 1).otherwise(0)).alias("without_job_count"),
        F.count("*").alias("total_count"),
    ]


def execution_hourly(
    tables: Tables, now: TimeLike, tml_id: str | None = None, eq_type: str | None = None, hours: int = 6
) -> DataFrame:
    scope = Scope(tml_id, eq_type)
    jobs = facts(tables, "bi_job_hist", scope, *rolling_window(now, hours))
    done = F.col("job_cmpl_time")
    hourly = _hourly(jobs, done, in_bucket(done, now, hours), *_job_counts())
    counts = _zero_where_absent("with_job_count", "without_job_count", "total_count")
    return onto_hours(tables, scope, hourly, now, hours).select(*HOUR_COLUMNS, *counts)


def execution_by_unit(
    tables: Tables, start: TimeLike, end: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    jobs = facts(tables, "bi_job_hist", Scope(tml_id, eq_type), start, end)
    return jobs.groupBy(*UNIT).agg(*_job_counts())


def execution_rows(
    tables: Tables,
    start: TimeLike,
    end: TimeLike,
    eq_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
) -> DataFrame:
    group = ["job_cmpl_time", "cntr_no", "eq_no", "job_type", "from_loc", "to_loc", "user_id"]
    dist = F.sum(F.coalesce(whole(F.col("step_dist")), F.lit(0))).alias("dist")
    rows = _job_rows(tables, Scope(tml_id, eq_type, eq_no), start, end, group, ["step_dist"], dist)
    out = ["job_cmpl_time", "cntr_no", "eq_no", "job_type", "from_loc", "to_loc", "dist", "user_id"]
    return numbered(rows, UNIT, group, "r_seq", hour_floor(F.col("job_cmpl_time"))).select(*KEYS, "r_seq", *out)
