"""Overall equipment effectiveness: one row of minutes per terminal, equipment type and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import DayLike, TimeLike, ceil_minutes, day_range, elapsed, round_minutes
from ..operators.intervals import pieces_with_contained
from ..operators.sessions import STRICT, clamp_to_days
from ..operators.spine import KEYS, UNIT, day_spine, spread
from ..operators.steps import sum_of
from ..operators.sweeps import UNIT_DAY, aggregate_inside
from ..sources.config import SETTINGS, pivot_config
from ..sources.schema import parsed, step_json
from ..sources.tables import Scope, Tables, scoped
from .utilization import KEY_DAY, ignitions, jobs_of_days, logins


def _jobs_with_steps(tables: Tables, scope: Scope, first, last) -> DataFrame:
    return jobs_of_days(tables, scope, first, last, F.col("bi_jh_job_cycle_step").isNotNull())


def _step_times(jobs: DataFrame, split_by_job: bool, outer: bool = False) -> DataFrame:
    """Microseconds of cycle steps, summed per job. Split by job, time without a job is kept apart; otherwise all counts.

    Jobs without steps have no row; with `outer` they have one without a day.
    """
    steps = parsed(jobs, "job_cycle_step", step_json("interval_sec", "activity_type")).alias("steps")
    rows = jobs.select(*UNIT_DAY, "job_id", "job_fetching_time", "job_cmpl_time", steps)
    some = F.size("steps") > 0
    rows = rows.withColumn("day", F.when(some, F.col("day"))) if outer else rows.where(some)
    every = sum_of("steps", lambda s: s["intervalSec"] * 1_000_000)
    waiting = sum_of("steps", lambda s: F.when(s["activityType"] == "Waiting", s["intervalSec"] * 1_000_000).otherwise(F.lit(0)))
    if split_by_job:
        with_job, none = F.col("job_id").isNotNull(), F.lit(0)
        parts = [F.when(with_job, every).otherwise(none), F.when(with_job, waiting).otherwise(none), F.when(with_job, none).otherwise(every)]
    else:
        parts = [every, waiting, F.lit(None)]
    names = ("job_us", "wait_us", "no_job_us")
    # whole microseconds would cut digits that JSON numbers may have
    sums = [p.cast("decimal(38,12)").alias(n) for p, n in zip(parts, names)]
    return rows.select(*UNIT_DAY, "job_fetching_time", "job_cmpl_time", *sums)


def _minutes_by_key(tables: Tables, scope: Scope, first, last, as_of: TimeLike, split_by_job: bool) -> DataFrame:
    ignition = clamp_to_days(ignitions(tables, scope, first), first, last, as_of, STRICT)
    login = clamp_to_days(logins(tables, scope, first), first, last, as_of, STRICT)
    jobs = _jobs_with_steps(tables, scope, first, last)
    worked = aggregate_inside(
        login,
        _step_times(jobs, split_by_job),
        "job_cmpl_time",
        {
            "first_fetch": ("min", "job_fetching_time"),
            "job_us": ("sum", "job_us"),
            "wait_us": ("sum", "wait_us"),
            "no_job_us": ("sum", "no_job_us"),
        },
        keep=["n"],
    )
    renamed = {"on_time": "in_time", "off_time": "out_time", "n": "n_logins"}
    pieces = pieces_with_contained(ignition, worked.withColumnsRenamed(renamed))
    # equal sessions and logins of a unit form one group, in which each copy adds its job seconds again
    copies = F.col("n") * F.col("n_logins")
    on, off, log_in, log_out = (F.col(c) for c in ("on_time", "off_time", "in_time", "out_time"))
    zero = F.lit(0).cast("bigint")
    per_login = {
        "job": ceil_minutes(F.col("job_us") * copies),
        "wait": ceil_minutes(F.col("wait_us") * copies),
        "no_job": ceil_minutes(F.col("no_job_us") * copies),
        "log_in_idle": F.greatest(ceil_minutes(elapsed(on, log_in)), zero),
        "log": ceil_minutes(elapsed(log_in, log_out)),
        "fetch_idle": F.greatest(ceil_minutes(elapsed(log_in, F.col("first_fetch"))), zero),
    }
    sums = [F.sum(name).alias(name) for name in per_login]
    # a session counts its own time once per login inside it, or once if there is none
    per_session = (
        pieces.withColumns(per_login)
        .groupBy(*UNIT_DAY, "on_time", "off_time")
        .agg(F.count("in_time").alias("logins"), *sums)
        .withColumn("util", ceil_minutes(elapsed(on, off)) * F.greatest(F.col("logins"), F.lit(1)))
    )
    sums.append(F.sum("util").alias("util"))
    # first per unit: counting units then needs no DISTINCT
    per_unit = per_session.groupBy(*UNIT_DAY).agg(*sums)
    return per_unit.groupBy(*KEY_DAY).agg((F.count("*") * 1440).alias("calendar"), *sums)


def _with_config(df: DataFrame, tables: Tables, scope: Scope) -> DataFrame:
    settings = {c: F.coalesce(F.col(c), F.lit(0)) for c in SETTINGS.values()}
    return df.join(pivot_config(tables, scope), KEYS, "left").withColumns(settings)


def _session_report(tables: Tables, day: DayLike, as_of: TimeLike, scope: Scope, split_by_job: bool) -> DataFrame:
    first, last = day_range(day)
    m = _with_config(_minutes_by_key(tables, scope, first, last, as_of, split_by_job), tables, scope)
    calendar, util, job, wait, no_job = (F.col(c) for c in ("calendar", "util", "job", "wait", "no_job"))
    close = F.col("tml_close_min")
    at = util + F.col("unsch_down_time_min")
    measures = {
        "calendar_time_min": calendar,
        "tml_close_min": close,
        "top_min": calendar - close,
        "no_demand_min": calendar - close - at - F.col("sch_down_time_min"),
        "sch_down_time_min": F.col("sch_down_time_min"),
        "at_min": at,
        "unsch_down_time_min": F.col("unsch_down_time_min"),
        "offline_opr_delay_min": F.col("offline_opr_delay_min"),
        "util_time_min": util,
        "online_opr_delay_min": util - job,
        "tos_failure_online_min": F.col("tos_failure_online_min"),
        "online_down_time_min": F.col("online_down_time_min"),
        "idle_time_min": util - job - F.col("tos_failure_online_min"),
        "log_in_idle_time_min": F.col("log_in_idle"),
        "job_fetching_idle_time_min": F.col("fetch_idle"),
        "drv_shift_idle_time_min": calendar - F.col("log"),
        "other_idle_time_min": F.col("other_idle_time_min"),
        "toc_min": job,
        "non_value_opr_time_min": wait,
        "vot_min": job - wait + no_job if split_by_job else job - wait,
    }
    if split_by_job:
        measures |= {"execution_with_job_min": job - wait, "rehandle_without_job_min": no_job}
    return m.select(*KEY_DAY, *[c.alias(n) for n, c in measures.items()])


def oee_vehicle(
    tables: Tables, day: DayLike, as_of: TimeLike, tml_id: str | None = None, eq_type: str | None = "YT"
) -> DataFrame:
    """Yard vehicles, type YT unless told otherwise. Days without ignition have no row."""
    return _session_report(tables, day, as_of, Scope(tml_id, eq_type), split_by_job=False)


def oee_crane(
    tables: Tables, day: DayLike, as_of: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    """Like the vehicle report, with work without a job kept apart."""
    return _session_report(tables, day, as_of, Scope(tml_id, eq_type), split_by_job=True)


def _ran_per_key(tables: Tables, scope: Scope, first, last, as_of: TimeLike) -> DataFrame:
    """Ignition of registered units: microseconds per key and day, and in rows without a day the number of units.

    Units and sessions meet in one grouping per unit, so that both tables are read once.
    """
    units = scoped(tables, "bi_eq", scope).groupBy(*UNIT).agg(F.count("*").alias("units"))
    ignition = clamp_to_days(ignitions(tables, scope, first), first, last, as_of, STRICT)
    on_micros = elapsed(F.col("on_time"), F.col("off_time")) * F.col("n")
    ran = ignition.groupBy(*UNIT_DAY).agg(F.sum(on_micros).alias("micros"))
    day = F.when(F.col("day").isNotNull(), F.struct("day", "micros"))
    per_unit = (
        ran.unionByName(units, allowMissingColumns=True)
        .groupBy(*UNIT)
        .agg(F.sum("units").alias("units"), F.collect_list(day).alias("days"))
        .where("units is not null")
    )
    own = F.array(F.struct(F.lit(None).cast("date").alias("day"), F.lit(None).cast("bigint").alias("micros")))
    rows = per_unit.select(*KEYS, "units", F.explode(F.concat(own, "days")).alias("of"))
    return rows.groupBy(*KEYS, F.col("of.day").alias("day")).agg(
        F.sum(F.when(F.col("of.day").isNull(), F.col("units"))).alias("units"),
        F.sum(F.col("of.micros") * F.col("units")).alias("micros"),
    )


def oee_tree(
    tables: Tables, day: DayLike, as_of: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    """Six levels of time. Totals are rounded once; days without ignition or jobs keep a row of NULL minutes."""
    scope, (first, last) = Scope(tml_id, eq_type), day_range(day)
    ran = _ran_per_key(tables, scope, first, last, as_of)
    worked = _step_times(_jobs_with_steps(tables, scope, first, last), split_by_job=True, outer=True)
    names = {"ign": "micros", "job": "job_us", "wait": "wait_us", "no_job": "no_job_us"}
    both = ran.unionByName(worked.groupBy(*KEY_DAY).agg(*[F.sum(c).alias(c) for c in list(names.values())[1:]]), allowMissingColumns=True)
    minutes = [round_minutes(F.sum(c)).alias(name) for name, c in names.items()]
    seen = both.groupBy(*KEY_DAY).agg(F.sum("units").alias("units"), *minutes)
    rows = spread(tables, scope, seen, "day", lambda keys: day_spine(keys, first, last), totals=("units",), registered=False)
    m = _with_config(rows, tables, scope)
    calendar = F.coalesce(F.col("units"), F.lit(0)) * 1440
    ign, job, wait, no_job = (F.col(c) for c in ("ign", "job", "wait", "no_job"))
    close, offline, unsch = F.col("tml_close_min"), F.col("offline_opr_delay_min"), F.col("unsch_down_time_min")
    sch, failure = F.col("sch_down_time_min"), F.col("tos_failure_online_min")
    toc = job + no_job
    measures = {
        "calendar_time_min": calendar,
        "top_min": calendar - close,
        "tml_close_min": close,
        "at_min": ign + unsch + offline,
        "sch_down_time_min": sch,
        "no_demand_min": calendar - close - ign - unsch - offline - sch,
        "util_time_min": ign,
        "offline_opr_delay_min": offline,
        "unsch_down_time_min": unsch,
        "toc_min": toc,
        "online_opr_delay_min": ign - toc,
        "vot_min": job - wait,
        "non_value_opr_time_min": wait,
        "idle_time_min": ign - toc - failure,
        "tos_failure_online_min": failure,
    }
    return m.select(*KEY_DAY, *[c.alias(n) for n, c in measures.items()])
