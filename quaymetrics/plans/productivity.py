"""Productivity reports: finished jobs by hour, by unit, and one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import container_length, counts_as_json
from ..functions.timeops import TimeLike, hour_floor
from ..operators.seq import numbered
from ..operators.spine import KEYS, UNIT, onto_hours, rolling_window
from ..sources.schema import CONTAINER_JSON, parsed
from ..sources.tables import Scope, Tables, facts, sorted_rows

COUNTS = ["job_qty", "job_type_qty_str", "cntr_len_qty_str"]


def _length(jobs: DataFrame) -> Column:
    return container_length(parsed(jobs, "cntr_attr", CONTAINER_JSON)["cntrIso"])


def counted(jobs: DataFrame, *by: str) -> DataFrame:
    """Per group: number of jobs, and JSON lists of the numbers by job type and by container length.

    One scan: rows are counted by (group, type) and (group, length) before the shuffle; only those few counts per
    group are collected into the lists.
    """
    jobs = jobs.withColumn("cntr_len", _length(jobs))
    counts = jobs.groupingSets([[*by, "job_type"], [*by, "cntr_len"]], *by, "job_type", "cntr_len").agg(
        F.grouping("cntr_len").alias("_by_type"), F.count("*").alias("qty")
    )
    by_type, by_length = F.col("_by_type") == 1, F.col("_by_type") == 0
    return counts.groupBy(*by).agg(
        F.sum(F.when(by_type, F.col("qty"))).alias("job_qty"),
        counts_as_json("jobType", F.col("job_type"), F.col("qty"), by_type).alias("job_type_qty_str"),
        counts_as_json("cntrLen", F.col("cntr_len"), F.col("qty"), by_length).alias("cntr_len_qty_str"),
    )


def productivity_hourly(
    tables: Tables, now: TimeLike, tml_id: str | None = None, eq_type: str | None = None, hours: int = 6
) -> DataFrame:
    """Hours without jobs have NULL counts and lists."""
    scope = Scope(tml_id, eq_type)
    jobs = facts(tables, "bi_job_hist", scope, *rolling_window(now, hours))
    hourly = counted(jobs.withColumn("s_time", hour_floor(F.col("job_cmpl_time"))), *KEYS, "s_time")
    rows = onto_hours(tables, scope, hourly, now, hours)
    return rows.select(*KEYS, F.col("s_time").alias("s_date"), F.col("e_time").alias("e_date"), "hour_step", *COUNTS)


def productivity_by_unit(
    tables: Tables, start: TimeLike, end: TimeLike, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    return counted(facts(tables, "bi_job_hist", Scope(tml_id, eq_type), start, end), *UNIT).select(*UNIT, *COUNTS)


def productivity_jobs(
    tables: Tables,
    start: TimeLike,
    end: TimeLike,
    eq_no: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
) -> DataFrame:
    """Jobs of a unit by completion time, numbered in that order."""
    scope = Scope(tml_id, eq_type, eq_no)
    jobs = facts(tables, "bi_job_hist", scope, start, end)
    columns = ["job_cmpl_time", "cntr_len", "eq_no", "cntr_no", "job_type", "from_eq_no", "to_eq_no", "user_id"]
    rows = jobs.withColumn("cntr_len", _length(jobs)).select(*KEYS, *columns)
    ties = ["cntr_no", "job_type", "from_eq_no", "to_eq_no", "user_id", "cntr_len"]
    ordered = numbered(rows, UNIT, ["job_cmpl_time", *ties], "seq", hour_floor(F.col("job_cmpl_time")))
    return sorted_rows(ordered.select(*KEYS, "seq", *columns), scope, *UNIT, "seq")
