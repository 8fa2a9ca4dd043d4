"""Plans, numbering, many keys at once, storage layout."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import timedelta

import pytest
from conftest import plan_of, rows, t
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quaymetrics.operators.seq import numbered
from quaymetrics.plans import execution as x
from quaymetrics.plans import oee, productivity
from quaymetrics.plans import utilization as u
from quaymetrics.session import prepare
from quaymetrics.sources.schema import LAYOUT_SESSION, LAYOUT_TIME, PREFIX
from quaymetrics.sources.tables import Tables, add, load, load_checks, save

DAY, AS_OF = "2024-01-12", "2024-01-12 18:00:00"
START, END = "2024-01-12 00:00:00", "2024-01-12 23:59:59.999"
NOW = "2024-01-12 10:30:00"
UNIT = "E000012"

DAY_REPORTS = [
    oee.oee_crane, oee.oee_tree, u.ignition_summary, u.ignition_by_session, u.login_summary, u.login_by_session,
    u.break_summary, u.break_by_session,
]
HOURLY = [
    x.travel_eff_hourly, x.travel_with_job_hourly, x.cycle_time_hourly, x.laden_hourly, x.fuel_hourly, x.execution_hourly,
    productivity.productivity_hourly,
]
RANGED = [
    x.travel_eff_by_job, x.travel_with_job_by_unit, x.cycle_time_by_job, x.laden_by_unit, x.fuel_by_unit, x.execution_by_unit,
    productivity.productivity_by_unit,
]
LISTS = [x.travel_with_job_rows, x.laden_rows, x.fuel_rows, x.execution_rows, productivity.productivity_jobs]
UNIT_HOURS = [u.ignition_hours, u.login_hours, u.break_hours]


def _id(report):
    return report.__name__


def _same(whole, single, **key):
    wanted = whole
    for column, value in key.items():
        wanted = wanted.where(F.col(column) == value)
    assert sorted(map(str, rows(wanted))) == sorted(map(str, rows(single)))


@pytest.mark.parametrize("report", DAY_REPORTS, ids=_id)
def test_day_report_of_all_keys_holds_the_single_key_report(derived, report):
    one = {"tml_id": "T1", "eq_type": "QC"}
    _same(report(derived, ("2024-01-11", "2024-01-12"), AS_OF), report(derived, DAY, AS_OF, **one), **one, day=DAY)


@pytest.mark.parametrize("report", HOURLY, ids=_id)
def test_hourly_report_of_all_keys_holds_the_single_key_report(derived, report):
    one = {"tml_id": "T1", "eq_type": "QC"}
    single = report(derived, NOW, **one)
    assert single.count() == 6
    _same(report(derived, NOW), single, **one)


@pytest.mark.parametrize("report", RANGED, ids=_id)
def test_range_report_of_all_keys_holds_the_single_key_report(derived, report):
    one = {"tml_id": "T1", "eq_type": "YT"}
    _same(report(derived, START, END), report(derived, START, END, **one), **one)


@pytest.mark.parametrize("report", LISTS, ids=_id)
def test_list_of_all_units_holds_the_list_of_one(derived, report):
    one = {"tml_id": "T1", "eq_type": "YT"}
    single = report(derived, START, END, UNIT, **one)
    assert single.count() > 0
    _same(report(derived, START, END), single, **one, eq_no=UNIT)


@pytest.mark.parametrize("report", UNIT_HOURS, ids=_id)
def test_hour_list_of_all_units_holds_the_list_of_one(derived, report):
    one = {"tml_id": "T1", "eq_type": "YT"}
    single = report(derived, DAY, AS_OF, UNIT, **one)
    assert single.count() > 0
    _same(report(derived, DAY, AS_OF), single, **one, eq_no=UNIT)


def test_sums_by_unit_equal_the_sum_of_the_window(derived):
    by_unit = x.execution_by_unit(derived, START, END).groupBy("tml_id", "eq_type").agg(F.sum("total_count").alias("n"))
    in_window = derived.bi_job_hist.where(F.col("bi_jh_job_cmpl_time").between(START, END)).count()
    assert sum(r.n for r in by_unit.collect()) == in_window


# numbering


def test_numbering_by_buckets_equals_the_window(spark):
    made = spark.range(20_000, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 997).alias("a"),
        F.col("id").alias("b"),
    )
    plain = numbered(made, ["k"], ["a", "b"], "seq")
    expected = sorted(map(str, rows(plain, "k", "a", "b", "seq")))
    for buckets in ([100], [500, 100, 10], [997, 1]):
        split = numbered(made, ["k"], ["a", "b"], "seq", *[F.floor(F.col("a") / n) for n in buckets])
        assert sorted(map(str, rows(split, "k", "a", "b", "seq"))) == expected


def test_texts_are_numbered_by_their_leading_characters(spark):
    made = spark.range(30_000, numPartitions=4).select(
        F.lit("E1").alias("k"), F.when(F.col("id") % 97 != 0, F.concat(F.lit("ABCU"), (F.col("id") * 7919 % 30_000).cast("string"))).alias("c"), "id"
    )
    split = numbered(made, ["k"], ["c", "id"], "seq", *[F.substring("c", 1, n) for n in (6, 9)], F.col("c"))
    plain = made.withColumn("seq", F.row_number().over(W.orderBy(F.asc_nulls_first("c"), "id")))
    assert split.exceptAll(plain.select(*split.columns)).isEmpty() and split.count() == 30_000
    # the running counts are over few rows each: no window orders a unit's containers
    windows = re.findall(r"Window \[sum[^\n]*\], \[([^\]]*)\], \[", re.sub(r"#\d+L?", "", plan_of(split)))
    assert sorted(w.count(",") for w in windows) == [0, 1, 2]


def test_a_crowded_hour_is_dealt_to_several_tasks(spark, make):
    """A unit with thousands of breaks and sessions in one hour: joins that may split both sides, and the rows of plain loops."""
    n = 3000
    crowd = [{"on": t("08:00") + timedelta(seconds=k), "off": t("08:59") + timedelta(milliseconds=k)} for k in range(n)]
    tables = make(
        bi_eq=[{}],
        bi_eq_ignition=[{"ign_on_time": "08:00", "ign_off_time": "09:30"}, {"ign_on_time": "10:00", "ign_off_time": "11:00"}],
        bi_eq_breaktime=[{"brk_start_time": c["on"], "brk_end_time": c["off"]} for c in crowd],
    )
    pairs = [r for r in u.break_by_session(tables, "2024-01-10", "2024-01-10 18:00:00").collect() if r.brk_start_time]
    assert len(pairs) == n and {r.ign_on_time for r in pairs} == {t("08:00")}
    hours = u.break_hours(tables, "2024-01-10", "2024-01-10 18:00:00")
    assert hours.count() == n + 2  # 09 and 10 o'clock have no break
    plans = [plan_of(u.break_hours(tables, "2024-01-10", AS_OF)), plan_of(u.break_by_session(tables, "2024-01-10", AS_OF))]
    assert all("Inner" in p and "LeftOuter" not in p for p in plans)


def test_envelopes_of_breaks_need_no_pairs(derived):
    plan = plan_of(u.break_summary(derived, ("2024-01-10", "2024-01-13"), AS_OF))
    assert "in_time" not in "".join(line for line in plan.splitlines() if "Join" in line)


@pytest.mark.parametrize("report", [oee.oee_vehicle, oee.oee_crane, u.ignition_summary, u.login_by_session, u.break_by_session, u.break_summary], ids=_id)
def test_sessions_are_read_once(spark, derived, tmp_path, report):
    df = report(_stored(spark, derived, tmp_path), ("2024-01-10", "2024-01-13"), AS_OF)
    df._jdf.collectToPython()
    final = plan_of(df).split("Initial Plan")[0]
    read = re.findall(r"FileScan parquet \[bi_(eg|el|eb)", final)
    assert read and len(read) == len(set(read))


@pytest.mark.parametrize("report", [x.travel_with_job_rows, x.laden_rows, x.fuel_rows, x.execution_rows, productivity.productivity_jobs], ids=_id)
def test_lists_read_the_jobs_once(spark, derived, tmp_path, report):
    df = report(_stored(spark, derived, tmp_path), START, END)
    df._jdf.collectToPython()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_hourly_and_day_reports_read_every_table_once(spark, derived, tmp_path):
    stored = _stored(spark, derived, tmp_path)
    reports = [report(stored, NOW) for report in HOURLY]
    reports += [r(stored, ("2024-01-10", "2024-01-13"), AS_OF) for r in (oee.oee_tree, u.ignition_summary, u.login_summary, u.break_summary)]
    for df in reports:
        df._jdf.collectToPython()
        read = re.findall(r"FileScan parquet \[(bi_[a-z]+)_", plan_of(df).split("Initial Plan")[0])
        assert read and len(read) == len(set(read)), read


def test_keys_seen_only_in_facts_without_steps_or_hours_get_their_rows(make):
    late = {"job_cmpl_time": "10:00", "job_id": "J", "job_cycle_step": "[]", "trv_with_eta": "[]"}
    early = {"job_cmpl_time": "04:31", "eq_type": "RTG", "job_id": "K", "job_cycle_step": "[]", "trv_with_eta": "[]"}  # before the first bucket
    tables = make(bi_eq=[{"eq_type": "QC"}], bi_job_hist=[{**late, "eq_type": "YT"}, early])
    for report in (x.travel_eff_hourly, x.cycle_time_hourly, x.execution_hourly, productivity.productivity_hourly):
        got = report(tables, "2024-01-10 10:30:00").groupBy("eq_type").count().collect()
        assert {r["eq_type"]: r["count"] for r in got} == {"QC": 6, "YT": 6, "RTG": 6}
    hour = x.cycle_time_hourly(tables, "2024-01-10 10:30:00").where("eq_type = 'YT'").collect()
    assert {(r.working_time_sec, r.waiting_time_sec) for r in hour} == {(None, 0)}
    tree = {r.eq_type: (r.calendar_time_min, r.toc_min) for r in oee.oee_tree(tables, "2024-01-10", "2024-01-10 18:00:00").collect()}
    assert tree == {"QC": (1440, None), "YT": (0, None), "RTG": (0, None)}


def test_building_a_report_starts_no_job(spark):
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        for name, build in entry._QUERIES.items():
            build(entry.derive(spark, "/root/testdata/sf0.001"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading Parquet schemas may start a job; a derived table asks for one each time
    assert len(jobs) <= len(entry._QUERIES)


def test_only_narrow_calls_are_sorted_as_a_whole(derived):
    days = ("2024-01-10", "2024-01-13")
    wide = [
        productivity.productivity_jobs(derived, START, END), x.travel_with_job_by_unit(derived, START, END),
        x.travel_with_job_rows(derived, START, END), u.avail_by_unit(derived, days), u.avail_hours(derived, days),
        u.ignition_hours(derived, days, AS_OF), u.login_hours(derived, days, AS_OF),
    ]
    assert not any("rangepartitioning" in plan_of(df) for df in wide)
    hours = u.avail_hours(derived, days, UNIT)
    got = rows(hours, "tml_id", "eq_type", "day", "eq_no", "hour_step")
    assert "rangepartitioning" in plan_of(hours) and got == sorted(got)


@pytest.mark.parametrize("report", UNIT_HOURS, ids=_id)
def test_hour_lists_shuffle_days_and_not_hours(derived, report):
    """Rows are dealt to hours after the join, so nothing is grouped or shuffled once an hour."""
    shuffles = [line for line in plan_of(report(derived, ("2024-01-10", "2024-01-13"), AS_OF)).splitlines() if "hashpartitioning" in line]
    assert shuffles and not any("hour" in line for line in shuffles)


@pytest.mark.parametrize("report, start, end", [(u.ignition_hours, "ign_on_time", "ign_off_time"), (u.login_hours, "log_in_time", "log_out_time")])
def test_hours_without_a_session(make, report, start, end):
    """No session in the hour, one that ends in an unaligned first hour, a reversed one beyond its day; a unit without a name has no rows."""
    table = "bi_eq_ignition" if "ign" in start else "bi_eq_login"
    given = {"E1": [("08:10", "08:40"), ("08:50", "09:30"), ("11:00", "11:20")], "E2": [("23:30", "21:00")], None: [("08:10", "09:30")]}
    tables = make(
        **{table: [{"eq_no": e, start: a, end: b} for e, some in given.items() for a, b in some]},
        bi_job_hist=[{"eq_no": e, "job_cmpl_time": "09:15", "job_fetching_time": "09:05"} for e in given],
    )
    hours = report(tables, "2024-01-10", "2024-01-10 18:00:00")
    got = sorted(rows(hours, "eq_no", "hour_seq", "job_start_time", "job_end_time"), key=str)
    work = (t("09:05"), t("09:15"))
    assert got == sorted(
        [("E1", 1, None, None), ("E1", 2, *work), ("E1", 3, None, None), ("E1", 4, None, None)]
        + [("E2", n, None, None) for n in (1, 2, 3)], key=str,
    )


def test_tasks_read_parts_of_shuffles_of_bounded_size(spark):
    """However few parts the session asks for; more of them are kept."""
    given = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for asked, parts in (("4", 200), ("500", 500)):
            spark.conf.set("spark.sql.shuffle.partitions", asked)
            prepare(spark)
            grouped = spark.range(100).groupBy("id").count()
            assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == parts
            assert f"hashpartitioning(id#, {parts})" in re.sub(r"#\d+L?", "#", plan_of(grouped))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
        prepare(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


# plans


@pytest.mark.parametrize("name", list(entry._QUERIES))
def test_plans_have_no_nested_loops_single_partitions_or_python(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to send around
    try:
        plan = plan_of(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for banned in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "PythonUDF", "BatchEvalPython", "ArrowEval", "MapInPandas"):
        assert banned not in plan


def test_filters_and_columns_reach_the_scan(spark, derived, tmp_path):
    stored = _stored(spark, derived, tmp_path)
    query = x.execution_by_unit(stored, START, END, "T1", "YT")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = re.sub(r"#\d+L?", "", query._jdf.queryExecution().explainString(mode))
    assert "EqualTo(bi_jh_eq_type,YT)" in plan and "GreaterThanOrEqual(bi_jh_job_cmpl_time" in plan
    read = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert set(re.findall(r"bi_jh_\w+", read)) == {"bi_jh_eq_type", "bi_jh_eq_no", "bi_jh_job_id", "bi_jh_job_cmpl_time"}
    partition = re.search(r"PartitionFilters: \[(.*)\]", plan).group(1)
    assert "bi_jh_tml_id = T1" in partition and "layout_day >= 2024-01-12" in partition


# storage


def _partition_filters(df) -> list[str]:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().explainString(mode))
    return re.findall(r"PartitionFilters: \[(.*)\]", plan)


def _stored(spark, derived: Tables, tmp_path) -> Tables:
    root = str(tmp_path / "tables")
    save(derived, root)
    return load(spark, root)


def _parts(tables: Tables, until) -> Tables:
    """What a load of the days up to `until` would bring: facts of one day, sessions begun by then, open if they end later."""
    day = F.to_date(F.lit(until))
    pick = {}
    for name, column in LAYOUT_TIME.items():
        pick[name] = getattr(tables, name).where(F.to_date(column) == day)
    for name, (on, off) in LAYOUT_SESSION.items():
        df = getattr(tables, name).where((F.to_date(on) <= day) & (F.col(off).isNull() | (F.to_date(off) >= day)))
        pick[name] = df.withColumn(off, F.when(F.to_date(off) <= day, F.col(off)))
    return replace(tables, **pick)


def test_days_added_one_by_one_equal_all_saved_at_once(spark, derived, tmp_path):
    days = [f"2024-01-{d:02d}" for d in range(10, 14)]
    first, last = F.lit(days[0]).cast("date"), F.lit(days[-1]).cast("date")
    whole = {n: getattr(derived, n).where(F.to_date(c).between(first, last)) for n, c in LAYOUT_TIME.items()}
    for n, (on, off) in LAYOUT_SESSION.items():  # each begins once per unit and start
        df = getattr(derived, n).where((F.to_date(on) >= first) & (F.to_date(on) <= last) & (F.col(off).isNull() | (F.col(off) >= F.col(on))))
        key = [f"{PREFIX[n]}_{c}" for c in ("tml_id", "eq_type", "eq_no")] + [on]
        whole[n] = df.dropDuplicates(key).withColumn(off, F.when(F.to_date(off) <= last, F.col(off)))
    whole = replace(derived, **whole)
    root = str(tmp_path / "daily")
    save(_parts(whole, days[0]), root)
    for day in [*days[1:], days[-1]]:  # the last one is loaded twice
        add(_parts(whole, day), root)
    save(whole, str(tmp_path / "once"))
    daily, once = load(spark, root), load(spark, str(tmp_path / "once"))
    for name in (*LAYOUT_TIME, *LAYOUT_SESSION):
        a, b = getattr(daily, name), getattr(once, name)
        assert a.count() == b.count() > 0 and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


def test_saved_tables_give_the_same_reports(spark, derived, tmp_path):
    stored = _stored(spark, derived, tmp_path)
    for build in (
        lambda tb: x.travel_with_job_by_unit(tb, START, END),
        lambda tb: x.fuel_hourly(tb, NOW),
        lambda tb: oee.oee_vehicle(tb, DAY, AS_OF),
        lambda tb: productivity.productivity_jobs(tb, START, END, UNIT),
    ):
        _same(build(derived), build(stored))


def test_load_checks_count_what_reports_would_lose(make):
    tables = make(
        bi_job_hist=[
            {"job_cycle_step": "[]", "trv_with_eta": '{"fromStep":"A"}'},
            {"job_cycle_step": "[broken", "trv_with_eta": None},
        ],
        bi_eq_tran=[{"event_step": "5"}],
        bi_eq_travel=[{"trv_stime": "09:00", "trv_etime": "08:00"}, {"trv_stime": "08:00", "trv_etime": "09:00"}],
    )
    assert dict(rows(load_checks(tables))) == {
        "job_cycle_step is not a JSON array": 1,
        "trv_with_eta is not a JSON array": 1,
        "event_step is not a JSON array": 1,
        "travel ends before it starts": 1,
        "job_cycle_step has what is no number": 0,
        "trv_with_eta has what is no number": 0,
        "event_step has what is no number": 0,
    }


def test_load_checks_count_fields_that_are_no_numbers(make):
    steps = ['[{"intervalSec":"abc"}]', '[{"trvDistance":1},{"intervalSec":1e30}]', '[{"intervalSec":12.5}]', "[{}]"]
    found = dict(rows(load_checks(make(bi_job_hist=[{"job_cycle_step": s} for s in steps], bi_eq_tran=[{"event_step": '[{"trvDistance":"x"}]'}]))))
    assert found["job_cycle_step has what is no number"] == 2 and found["event_step has what is no number"] == 1


def test_the_other_terminal_of_a_fact_only_key_still_gets_its_hours(make):
    tables = make(bi_eq=[{}], bi_job_hist=[{"tml_id": "T7", "job_cmpl_time": t("08:10"), "job_id": "J"}])
    got = x.execution_hourly(tables, "2024-01-10 10:30:00")
    assert got.where("tml_id = 'T7'").count() == 6
    assert got.agg(F.sum("total_count")).first()[0] == 1


def test_stored_tables_are_parsed_and_pruned_on_both_sides(spark, derived, tmp_path):
    stored = _stored(spark, derived, tmp_path)
    for build in (
        lambda tb: x.laden_rows(tb, START, END), lambda tb: x.travel_eff_legs(tb), lambda tb: oee.oee_crane(tb, DAY, AS_OF),
        lambda tb: x.laden_by_unit(tb, START, END), lambda tb: productivity.productivity_by_unit(tb, START, END),
    ):
        assert "from_json" not in plan_of(build(stored)) and "from_json" in plan_of(build(derived))
    (trip,) = {f for f in _partition_filters(x.fuel_by_unit(stored, START, END, "T1", "YT")) if "bi_ev_tml_id" in f}
    assert "layout_day" in trip and ">= 2024-01-12" in trip and "<= 2024-01-12" in trip
    for report, prefix in ((u.ignition_by_session, "bi_eg"), (u.login_by_session, "bi_el"), (u.break_by_session, "bi_eb")):
        filters = [f for f in _partition_filters(report(stored, DAY, AS_OF)) if f"{prefix}_tml_id" in f]
        assert filters and all("layout_day" in f and ">= 2024-01-12" in f for f in filters)
    for report in DAY_REPORTS:
        _same(report(derived, DAY, AS_OF), report(stored, DAY, AS_OF))
    for build in (lambda tb: x.travel_with_job_by_unit(tb, START, END), lambda tb: x.travel_eff_by_job(tb, START, END)):
        _same(build(derived), build(stored))
