"""Reports on hand-made rows: one test per rule that must be kept. The test day is 2024-01-10, key T1 / YT / E1."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from conftest import rows, t

from quaymetrics.plans import execution as x
from quaymetrics.plans import oee, productivity
from quaymetrics.plans import utilization as u
from quaymetrics.sources.config import oee_config_list, oee_config_set

DAY = "2024-01-10"
AS_OF = "2024-01-10 18:00:00"
NOW = "2024-01-10 10:30:00"
START, END = t("00:00"), t("23:59:59.999")
ONE = {"tml_id": "T1", "eq_type": "YT"}


def steps(*items) -> str:
    keys = ("intervalSec", "activityType", "trvDistance", "ladenStatus")
    return json.dumps([dict(zip(keys, item)) for item in items])


def legs(*items) -> str:
    keys = ("fromStep", "toStep", "etaDistance", "ataDistance", "etaTimeSec", "ataTimeSec")
    return json.dumps([dict(zip(keys, item)) for item in items])


def job(done: str, fetched: str | None = None, **more) -> dict:
    return {"job_id": "J1", "job_cmpl_time": done, "job_fetching_time": fetched, **more}


# productivity


def test_counts_keep_null_labels_and_empty_hours_are_null(make):
    tables = make(
        bi_job_hist=[
            job("08:10", job_type="LD", cntr_attr='{"cntrIso":"22G1"}'),
            job("08:20", job_type="LD", cntr_attr='{"cntrIso":""}'),
            job("08:59:59.999500", job_type=None, cntr_attr="{}"),
            job("04:40", job_type="LD"),  # read, but before the first bucket
        ]
    )
    got = {r.hour_step: r for r in productivity.productivity_hourly(tables, NOW, **ONE).collect()}
    assert len(got) == 6
    # keyed by the hour's text, so the last microseconds of the hour count here
    assert got["2024011008"].job_qty == 3
    assert got["2024011008"].job_type_qty_str == '[{"jobType":null,"jobQty":1},{"jobType":"LD","jobQty":2}]'
    assert json.loads(got["2024011008"].cntr_len_qty_str) == [
        {"cntrLen": None, "jobQty": 1}, {"cntrLen": "20", "jobQty": 1}, {"cntrLen": "40", "jobQty": 1},
    ]
    empty = got["2024011009"]
    assert (empty.job_qty, empty.job_type_qty_str, empty.cntr_len_qty_str) == (None, None, None)


def test_job_list_is_numbered_by_completion(make):
    tables = make(bi_job_hist=[job("09:00", cntr_no="B"), job("08:00", cntr_no="A"), job("07:00", eq_no="E2"), job("06:00", eq_no=None)])
    assert rows(productivity.productivity_jobs(tables, START, END, "E1", **ONE), "seq", "cntr_no") == [(1, "A"), (2, "B")]
    every = rows(productivity.productivity_jobs(tables, START, END), "eq_no", "seq")
    assert every == [("E1", 1), ("E1", 2), ("E2", 1)]


# execution


def test_leg_numbers_round_before_they_are_summed(make):
    tables = make(bi_job_hist=[job("08:00", cntr_no="C1", trv_with_eta=legs(("A", "B", 12.5, 1.4, 10, 12), ("B", "C", 12.5, 1.4, 10, 5)))])
    hourly = {r.hour_step: r for r in x.travel_eff_hourly(tables, NOW, **ONE).collect()}
    assert (hourly["2024011008"].eta_distance, hourly["2024011008"].ata_distance) == (26, 2)
    assert hourly["2024011007"].eta_distance is None
    detail = rows(x.travel_eff_legs(tables, "J1", "C1", **ONE), "r_seq", "from_step", "eta_distance", "trv_efc_time", "trv_efc_distance")
    assert detail == [(1, "A", 13, 2, -12), (2, "B", 13, -5, -12)]
    assert rows(x.cycle_time_legs(tables, "J1", **ONE), "r_seq", "to_step") == [(1, "B"), (2, "C")]
    assert rows(x.travel_eff_legs(tables, "J1", "other", **ONE)) == []


def test_jobs_without_usable_steps_vanish(make):
    tables = make(
        bi_job_hist=[
            job("08:00", cntr_no="A", job_cycle_step=steps((5, "Working", 2.5, "L"), (7, None, 2.5, "U"))),
            job("08:01", cntr_no="B", job_cycle_step="[]"),
            job("08:02", cntr_no="C", job_cycle_step=None),
            job("08:03", cntr_no="D", job_cycle_step="not json"),
        ]
    )
    assert rows(x.travel_with_job_rows(tables, START, END, "E1", **ONE), "cntr_no", "dist") == [("A", 6)]
    assert rows(x.execution_rows(tables, START, END, "E1", **ONE), "cntr_no", "dist") == [("A", 6)]
    assert rows(x.laden_rows(tables, START, END, "E1", **ONE), "laden_dist", "unladen_dist", "total_dist") == [(3, 3, 6)]
    assert rows(x.cycle_time_by_job(tables, START, END, **ONE), "working_time", "waiting_time", "total_time") == [(12, 0, 12)]


def test_the_same_distance_is_rounded_by_unit_but_not_by_hour(make):
    tables = make(bi_eq_tran=[{"last_job_cmpl_time": "08:00", "event_step": steps((1, None, 0.5, "L"), (1, None, 0.5, "L"), (1, None, 3, "U"))}])
    hour = [r for r in x.laden_hourly(tables, NOW, **ONE).collect() if r.hour_step == "2024011008"][0]
    assert (hour.laden_dist, hour.unladen_dist) == (D("1.000000"), D("3.000000"))
    assert rows(x.laden_by_unit(tables, START, END, **ONE), "laden_dist", "unladen_dist", "total_dist") == [(2, 3, 5)]


def test_what_empty_hours_show(make):
    tables = make()
    assert set(rows(x.cycle_time_hourly(tables, NOW, **ONE), "working_time_sec", "waiting_time_sec")) == {(None, 0)}
    assert set(rows(x.laden_hourly(tables, NOW, **ONE), "laden_dist", "unladen_dist")) == {(0, 0)}
    assert set(rows(x.travel_eff_hourly(tables, NOW, **ONE), "eta_distance", "ata_time_sec")) == {(None, None)}
    assert set(rows(x.travel_with_job_hourly(tables, NOW, **ONE), "trv_dist", "trv_job_dist")) == {(None, None)}
    assert set(rows(x.fuel_hourly(tables, NOW, **ONE), "fuel")) == {(0,)}
    assert set(rows(x.execution_hourly(tables, NOW, **ONE), "with_job_count", "without_job_count", "total_count")) == {(0, 0, 0)}


def test_the_last_microseconds_of_an_hour_are_in_no_range_bucket(make):
    tables = make(bi_job_hist=[job("08:59:59.999500"), job("08:59:59.999"), job("10:30"), job("10:30:00.000001")])
    counts = {r.hour_step: r.total_count for r in x.execution_hourly(tables, NOW, **ONE).collect()}
    assert (counts["2024011008"], counts["2024011009"], counts["2024011010"]) == (1, 0, 1)


def test_trips_over_the_hour_have_fuel_in_no_bucket_but_distance_in_their_end_hour(make):
    def trip(start, end, fuel, dist=1.0):
        return {"trv_stime": start, "trv_etime": end, "fuel": fuel, "dist": dist}

    tables = make(
        bi_eq_travel=[trip("08:10", "08:20", 2.5), trip("08:30", "08:40", None), trip("08:50", "09:10", 9.0, 1.5), trip("08:20", "08:10", 1.0, 0)]
    )
    fuel = {r.hour_step: r.fuel for r in x.fuel_hourly(tables, NOW, **ONE).collect()}
    assert (fuel["2024011008"], fuel["2024011009"]) == (D("3.500000"), 0)
    dist = {r.hour_step: r.trv_dist for r in x.travel_with_job_hourly(tables, NOW, **ONE).collect()}
    assert (dist["2024011008"], dist["2024011009"]) == (2, 2)
    assert rows(x.fuel_by_unit(tables, START, END, **ONE), "fuel_cons", "job_fuel") == [(D("12.500000"), None)]


def test_the_difference_of_distances_mixes_rounded_and_exact(make):
    tables = make(
        bi_eq_travel=[{"trv_stime": "08:00", "trv_etime": "08:10", "dist": 10.5}],
        bi_eq_tran=[{"last_job_cmpl_time": "08:10", "trv_dist": 4.25}, {"eq_no": "E2", "last_job_cmpl_time": "08:10", "trv_dist": 4}],
    )
    got = rows(x.travel_with_job_by_unit(tables, START, END, **ONE), "eq_no", "total_dist", "job_dist", "no_job_dist")
    assert got == [("E1", 11, D("4.250000"), D("6.750000"))]  # E2 never travelled: no row


def test_fuel_rows_merge_jobs_that_look_alike(make):
    alike = dict(cntr_no="C1", job_type="LD", fuel=1.5, user_id="U1", job_cycle_step=steps((1, None, 2.5, "L")))
    tables = make(bi_job_hist=[job("08:00", **alike), job("09:00", **{**alike, "job_id": "J2"})])
    assert rows(x.fuel_rows(tables, START, END, "E1", **ONE), "r_seq", "trv_dist", "fuel") == [(1, 6, D("1.500000"))]


def test_null_jobs_form_a_group_in_job_sums(make):
    leg = legs(("A", "B", 1, 2, 3, 4))
    tables = make(bi_job_hist=[job("08:00", job_id=None, trv_with_eta=leg), job("09:00", job_id=None, trv_with_eta=leg)])
    assert rows(x.travel_eff_by_job(tables, START, END, **ONE), "job_id", "eta_distance") == [(None, 2)]
    assert rows(x.cycle_time_by_job(tables, START, END, **ONE)) == []
    assert rows(x.execution_by_unit(tables, START, END, **ONE), "with_job_count", "without_job_count", "total_count") == [(0, 2, 2)]


# utilisation


def test_available_hours_skip_retired_units_and_keep_empty_keys(make):
    tables = make(
        bi_eq=[{"remove_flag": None}, {"eq_no": "E2", "remove_flag": "N"}, {"eq_no": "E3", "remove_flag": "Y"}, {"eq_type": "QC", "remove_flag": "Y"}],
        bi_job_hist=[job("08:30", "07:00"), job("09:00", "08:40"), job("10:00", "08:00", eq_no="E3")],
    )
    assert sorted(rows(u.avail_summary(tables, DAY), "eq_type", "available_hour", "job_performed_hour")) == [("QC", 0, None), ("YT", 48, 2)]
    by_unit = rows(u.avail_by_unit(tables, DAY, **ONE), "eq_no", "avail_min", "job_start_time", "job_performed_min")
    assert by_unit == [("E1", 1440, t("07:00"), 120), ("E2", 1440, None, None)]


def test_a_job_without_fetch_starts_with_the_day(make):
    tables = make(bi_eq=[{}], bi_job_hist=[job("08:30", None)])
    assert rows(u.avail_by_unit(tables, DAY, **ONE), "job_start_time", "job_performed_min") == [(START, 510)]


def test_hour_minutes_run_from_the_start_of_work(make):
    tables = make(bi_eq=[{}], bi_job_hist=[job("10:10", "08:50")])
    got = rows(u.avail_hours(tables, DAY, "E1", **ONE), "hour_step", "job_start_time", "job_end_time", "job_performed_time_min")
    assert len(got) == 24
    assert got[7:11] == [(8, None, None, None), (9, t("08:50"), None, 10), (10, None, None, 70), (11, None, t("10:10"), 80)]


def test_only_the_ignition_summary_counts_work_fetched_before_the_day(make):
    tables = make(
        bi_eq_ignition=[{"ign_on_time": "2024-01-09 22:00", "ign_off_time": "02:00"}],
        bi_job_hist=[job("01:00", "2024-01-09 23:00")],
    )
    assert rows(u.ignition_summary(tables, DAY, AS_OF, **ONE), "ign_time_min", "job_performed_time_min") == [(120, 120)]
    listed = rows(u.ignition_by_session(tables, DAY, AS_OF, **ONE), "ign_start_time", "job_start_time", "job_performed_time_min")
    assert listed == [(START, START, 60)]


def test_login_list_rounds_where_the_summary_rounds_up(make):
    tables = make(bi_eq_login=[{"log_in_time": "08:00", "log_out_time": "08:10:20"}], bi_job_hist=[job("08:05:20", "08:00")])
    assert rows(u.login_summary(tables, DAY, AS_OF, **ONE), "log_time_min", "job_performed_time_min") == [(11, 6)]
    assert rows(u.login_by_session(tables, DAY, AS_OF, **ONE), "log_time_min", "job_performed_time_min") == [(10, 5)]


def test_summaries_keep_a_row_without_sessions(make):
    tables = make(bi_eq=[{}])
    for report in (u.ignition_summary, u.login_summary, u.break_summary):
        assert [r[3:] for r in rows(report(tables, DAY, AS_OF))] == [(None, None)]
        assert [r[:2] + r[3:] for r in rows(report(tables, DAY, AS_OF, tml_id="T9", eq_type="ZZ"))] == [("T9", "ZZ", None, None)]


def test_a_session_inside_its_first_clock_hour_is_missed_by_work_but_not_by_breaks(make):
    tables = make(
        bi_eq_ignition=[{"ign_on_time": "08:50", "ign_off_time": "08:59"}],
        bi_job_hist=[job("08:55", "08:52")],
        bi_eq_breaktime=[{"brk_start_time": "08:51", "brk_end_time": "08:55"}],
    )
    work = rows(u.ignition_hours(tables, DAY, AS_OF, "E1", **ONE), "hour_seq", "ign_start_time", "job_end_time", "job_performed_time_min")
    assert work == [(1, t("08:50"), None, None)]
    pause = rows(u.break_hours(tables, DAY, AS_OF, "E1", **ONE), "hour_seq", "brk_start_time", "brk_end_time", "brk_time_min")
    assert pause == [(1, t("08:51"), t("08:55"), 4)]


def test_hour_rows_of_a_span_and_the_sessions_in_them(make):
    tables = make(
        bi_eq_login=[{"log_in_time": "08:50", "log_out_time": "10:10"}],
        bi_job_hist=[job("09:30", "08:55")],
    )
    got = rows(u.login_hours(tables, DAY, AS_OF, "E1", **ONE), "hour_seq", "log_start_time", "log_end_time", "job_start_time", "job_end_time", "job_performed_time_min")
    assert got == [
        (1, t("08:50"), t("08:59:59.999"), t("08:55"), None, 5),
        (2, t("09:00"), t("10:10"), None, t("09:30"), 35),
    ]


def test_breaks_must_lie_inside_a_session_and_come_once_per_pair(make):
    tables = make(
        bi_eq_ignition=[{"ign_on_time": "08:00", "ign_off_time": "12:00"}, {"ign_on_time": "13:00", "ign_off_time": "14:00"}],
        bi_eq_breaktime=[
            {"brk_start_time": "09:00", "brk_end_time": "09:10:30"},
            {"brk_start_time": "09:00", "brk_end_time": "09:10:30"},
            {"brk_start_time": "11:00", "brk_end_time": "11:05"},
            {"brk_start_time": "11:50", "brk_end_time": "12:10"},
        ],
    )
    got = sorted(rows(u.break_by_session(tables, DAY, AS_OF, **ONE), "ign_on_time", "brk_start_time", "brk_time_min"), key=str)
    expected = [(t("08:00"), t("09:00"), 11), (t("08:00"), t("09:00"), 11), (t("08:00"), t("11:00"), 5), (t("13:00"), None, None)]
    assert got == sorted(expected, key=str)
    # the break measure is the envelope 09:00-11:05
    assert rows(u.break_summary(tables, DAY, AS_OF, **ONE), "ign_time_min", "brk_end_time_min") == [(300, 125)]


# effectiveness


CONFIG = [
    {"tml_gp": gp, "value_type": name, "value": value, "value_seq": seq}
    for seq, (name, value) in enumerate([("SCH_DOWN", "60"), ("USCH_DOWN", "45.5"), ("TML_CLOSE", "120"), ("TOS_FAILURE_ONLINE", "15")], 1)
    for gp, value in (("G1", value), ("G2", str(float(value) + 1)))
]


def test_vehicle_minutes(make):
    tables = make(
        bi_eq_ignition=[{"ign_on_time": "08:00", "ign_off_time": "10:00"}],
        bi_eq_login=[{"log_in_time": "08:10", "log_out_time": "09:10"}],
        bi_job_hist=[
            job("08:40", "08:15", job_cycle_step=steps((600, "Working", 1, "L"), (301, "Waiting", 1, "L"))),
            job("08:50", "08:12", job_id=None, job_cycle_step=steps((60, "Working", 1, "L"))),
            job("08:55", "08:11", job_cycle_step="[]"),  # gives no fetch either
            job("09:30", "09:15", job_cycle_step=steps((999, "Working", 1, "L"))),  # outside the login
        ],
        bi_oee_tml_value=CONFIG,
    )
    (row,) = oee.oee_vehicle(tables, DAY, AS_OF, tml_id="T1").collect()
    assert row.day == date(2024, 1, 10)
    assert row.calendar_time_min == 1440 and row.tml_close_min == 121 and row.top_min == 1319
    assert row.util_time_min == 120 and row.at_min == D("166.5") and row.sch_down_time_min == 61
    assert row.no_demand_min == D("1091.5")
    assert row.toc_min == 17 and row.non_value_opr_time_min == 6 and row.vot_min == 11  # 961 s and 301 s
    assert row.online_opr_delay_min == 103 and row.idle_time_min == 87
    assert (row.log_in_idle_time_min, row.job_fetching_idle_time_min, row.drv_shift_idle_time_min) == (10, 2, 1380)
    assert row.other_idle_time_min == 0
    (crane,) = oee.oee_crane(tables, DAY, AS_OF, tml_id="T1").collect()
    assert (crane.toc_min, crane.execution_with_job_min, crane.rehandle_without_job_min, crane.vot_min) == (16, 10, 1, 11)
    (tree,) = oee.oee_tree(make(bi_eq=[{"remove_flag": "Y"}], **{}), DAY, AS_OF).collect()
    assert (tree.calendar_time_min, tree.util_time_min, tree.toc_min) == (1440, None, None)


def test_two_logins_count_the_session_twice_and_no_jobs_leave_nulls(make):
    tables = make(
        bi_eq_ignition=[{"ign_on_time": "08:00", "ign_off_time": "10:00"}, {"eq_no": "E2", "ign_on_time": "08:00", "ign_off_time": "08:30"}],
        bi_eq_login=[{"log_in_time": "08:10", "log_out_time": "08:20"}, {"log_in_time": "09:10", "log_out_time": "09:20"}],
    )
    (row,) = oee.oee_vehicle(tables, DAY, AS_OF, tml_id="T1").collect()
    assert (row.calendar_time_min, row.util_time_min) == (2880, 270)
    assert (row.log_in_idle_time_min, row.drv_shift_idle_time_min) == (80, 2860)
    assert (row.toc_min, row.online_opr_delay_min, row.idle_time_min) == (None, None, None)


def test_copies_of_open_sessions_repeat_their_job_time(make):
    tables = make(
        bi_eq_ignition=[{"ign_on_time": "2024-01-08 01:00", "ign_off_time": None}, {"ign_on_time": "2024-01-09 01:00", "ign_off_time": None}],
        bi_eq_login=[{"log_in_time": "08:00", "log_out_time": "09:00"}],
        bi_job_hist=[job("08:30", "08:10", job_cycle_step=steps((90, "Working", 1, "L")))],
    )
    (row,) = oee.oee_vehicle(tables, DAY, AS_OF, tml_id="T1").collect()
    assert (row.util_time_min, row.toc_min) == (1080, 3)  # one merged session up to as_of; 2 x 90 s


def test_no_ignition_gives_no_vehicle_row_but_a_tree_row(make):
    tables = make(bi_eq=[{}, {"eq_no": "E2", "remove_flag": "Y"}], bi_oee_tml_value=CONFIG)
    assert rows(oee.oee_vehicle(tables, DAY, AS_OF, tml_id="T1")) == []
    (tree,) = oee.oee_tree(tables, DAY, AS_OF, **ONE).collect()
    assert (tree.calendar_time_min, tree.top_min, tree.util_time_min, tree.at_min, tree.vot_min) == (2880, 2759, None, None, None)


def test_tree_rounds_the_total_and_counts_registered_units_only(make):
    sessions = [{"ign_on_time": "08:00", "ign_off_time": "08:00:20"}, {"ign_on_time": "09:00", "ign_off_time": "09:00:20"}]
    tables = make(
        bi_eq=[{}],
        bi_eq_ignition=[*sessions, {"eq_no": "E9", "ign_on_time": "08:00", "ign_off_time": "12:00"}],
        bi_job_hist=[job("08:00", "07:00", job_cycle_step=steps((89, "Waiting", 1, "L"))), job("09:00", "08:00", job_id=None, job_cycle_step=steps((31, None, 1, "L")))],
    )
    (tree,) = oee.oee_tree(tables, DAY, AS_OF, **ONE).collect()
    assert (tree.util_time_min, tree.toc_min, tree.non_value_opr_time_min, tree.vot_min) == (1, 2, 1, 0)


def test_config_list_and_set(make):
    tables = make(bi_oee_tml_value=CONFIG)
    listed = rows(oee_config_list(tables, "G1", "T1", "YT"), "bi_ov_value_type", "bi_ov_value")
    assert listed == [("SCH_DOWN", "60"), ("USCH_DOWN", "45.5"), ("TML_CLOSE", "120"), ("TOS_FAILURE_ONLINE", "15")]
    changed = oee_config_set(tables, "SCH_DOWN", "70", "G1", "T1", "YT").where("bi_ov_value_type = 'SCH_DOWN'")
    assert sorted(rows(changed, "bi_ov_tml_gp", "bi_ov_value")) == [("G1", "70"), ("G2", "61.0")]


def test_bad_config_text_raises(make):
    tables = make(bi_eq_ignition=[{"ign_on_time": "08:00", "ign_off_time": "10:00"}], bi_oee_tml_value=[{"tml_gp": "G1", "value_type": "SCH_DOWN", "value": "x"}])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        oee.oee_vehicle(tables, DAY, AS_OF, tml_id="T1").collect()


def test_work_is_read_by_day_with_its_gap(make):
    late = datetime(2024, 1, 10, 23, 59, 59, 999500)
    tables = make(bi_eq=[{}], bi_job_hist=[job("2024-01-10 23:59:59.999500", "23:00"), job("2024-01-11 01:00", "23:30")])
    assert late > END
    got = rows(u.avail_by_unit(tables, (DAY, "2024-01-11"), **ONE), "day", "job_end_time")
    assert got == [(date(2024, 1, 10), None), (date(2024, 1, 11), datetime(2024, 1, 11, 1))]


# digits beyond the sixth


def test_json_numbers_are_rounded_once(make):
    tables = make(bi_job_hist=[
        job("08:10", "08:00", job_cycle_step='[{"intervalSec":12.4999999,"trvDistance":12.4999999,"ladenStatus":"L"},{"intervalSec":1.25e1,"trvDistance":2.5,"ladenStatus":"L"}]', cntr_no="C"),
    ])
    range_ = "2024-01-10 00:00:00", "2024-01-10 23:59:59"
    assert rows(x.laden_rows(tables, *range_, **ONE), "laden_dist") == [(15,)]
    assert rows(x.cycle_time_by_job(tables, *range_, **ONE), "total_time") == [(25,)]
