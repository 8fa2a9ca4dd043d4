"""Clamping, overlap rules, spines and interval joins on hand-made rows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from conftest import rows, t
from pyspark.sql import functions as F

from quaymetrics.functions.measures import container_length, whole
from quaymetrics.functions.timeops import ceil_hours, ceil_minutes, hour_number, round_minutes
from quaymetrics.operators.intervals import contains_interval
from quaymetrics.operators.sessions import LOOSE, LOOSE_NOW, STRICT, clamp_to_days, overlaps_day_loose, overlaps_day_strict
from quaymetrics.operators.spine import hour_spine, in_bucket, span_hours
from quaymetrics.operators.sweeps import aggregate_inside

DAY = date(2024, 1, 10)
START = datetime(2024, 1, 10)
END = datetime(2024, 1, 10, 23, 59, 59, 999000)
SESSION = "tml_id string, eq_type string, eq_no string, on_time timestamp_ntz, off_time timestamp_ntz"


def sessions(spark, *pairs):
    return spark.createDataFrame([("T1", "YT", "E1", on, off) for on, off in pairs], SESSION)


def five_branches(on, off, start, end):
    if off is None:
        return on < end
    return (
        (on >= start and off <= end)
        or (off > start and on < start)
        or (on < end and off > end)
        or (on < start and off > end)
    )


def test_strict_overlap_equals_the_five_branches_on_a_grid(spark):
    marks = [START - timedelta(hours=1), START, START + timedelta(hours=1), END - timedelta(hours=1), END, END + timedelta(hours=1)]
    pairs = [(on, off) for on in marks for off in [*marks, None]]
    df = sessions(spark, *pairs).withColumn("hit", overlaps_day_strict(F.col("on_time"), F.col("off_time"), F.lit(START).cast("timestamp_ntz"), F.lit(END).cast("timestamp_ntz")))
    got = {(r.on_time, r.off_time): bool(r.hit) for r in df.collect()}
    assert got == {(on, off): five_branches(on, off, START, END) for on, off in pairs}


@pytest.mark.parametrize(
    ("on", "off", "strict", "loose"),
    [
        (START - timedelta(hours=1), START, False, True),  # ends on the first instant
        (END, END + timedelta(hours=1), False, True),  # starts on the last instant
        (END, None, False, True),
        (END, END, True, True),
        (START + timedelta(hours=3), START + timedelta(hours=2), True, True),  # reversed, inside
        (START - timedelta(days=9), None, True, True),  # left open long ago
        (START - timedelta(hours=2), START - timedelta(hours=1), False, False),
    ],
)
def test_edges_of_both_overlap_rules(spark, on, off, strict, loose):
    lit = lambda v: F.lit(v).cast("timestamp_ntz")
    row = sessions(spark, (on, off)).select(
        overlaps_day_strict(F.col("on_time"), F.col("off_time"), lit(START), lit(END)),
        overlaps_day_loose(F.col("on_time"), F.col("off_time"), lit(START), lit(END), lit(END)),
    )
    assert [tuple(bool(hit) for hit in r) for r in rows(row)] == [(strict, loose)]  # NULL does not match either


def test_open_sessions_end_at_as_of_or_with_the_day(spark):
    opened = sessions(spark, (t("08:00"), None))
    as_of = t("18:00")
    ends = {rule: rows(clamp_to_days(opened, DAY, DAY, as_of, rule), "off_time") for rule in (STRICT, LOOSE, LOOSE_NOW)}
    assert ends == {STRICT: [(as_of,)], LOOSE: [(END,)], LOOSE_NOW: [(as_of,)]}


def test_equal_pieces_are_merged_with_their_number(spark):
    long_open = [(datetime(2024, 1, d), None) for d in (3, 4, 5)]
    cut = clamp_to_days(sessions(spark, *long_open), DAY, DAY, datetime(2024, 1, 20), STRICT)
    assert rows(cut, "on_time", "off_time", "n") == [(START, END, 3)]


@pytest.mark.parametrize("rule", [STRICT, LOOSE, LOOSE_NOW])
def test_many_days_equal_the_union_of_single_days(spark, rule):
    d = lambda day, hour=0, minute=0: datetime(2024, 1, day, hour, minute)
    pairs = [
        (d(8, 5), d(8, 6)), (d(8, 23), d(9, 1)), (d(7), d(12)), (d(9), d(9)), (d(9), d(10)), (d(8, 1), d(11, 2)),
        (d(8, 5), None), (d(5), None), (d(5), None), (d(11, 4), None), (d(13, 4), None), (d(11, 4), d(9, 3)),
        (d(20), d(9, 3)), (d(12, 1), d(2)), (d(20), d(21)), (d(1), d(2)), (END, d(11)), (END + timedelta(microseconds=500), d(11, 3)),
        (d(9, 1), END + timedelta(microseconds=500)), (END, END), (d(8), d(30)),
    ]
    df = sessions(spark, *pairs)
    first, last, as_of = date(2024, 1, 8), date(2024, 1, 13), d(11, 12)
    columns = ["day", "on_time", "off_time", "n"]
    whole_range = rows(clamp_to_days(df, first, last, as_of, rule), *columns)
    single = []
    for i in range(6):
        day = first + timedelta(days=i)
        single += rows(clamp_to_days(df, day, day, as_of, rule), *columns)
    assert sorted(whole_range) == sorted(single)
    assert whole_range


def test_rolling_spine_ends_at_now_and_keeps_the_millisecond_gap(spark):
    keys = spark.createDataFrame([("T1", "YT")], "tml_id string, eq_type string")
    spine = rows(hour_spine(keys, "2024-01-10 10:30:00"), "s_time", "e_time", "hour_step")
    assert len(spine) == 6
    assert spine[0] == (t("05:00"), t("05:59:59.999"), "2024011005")
    assert spine[-1] == (t("10:00"), t("10:30"), "2024011010")
    whole_hour = rows(hour_spine(keys, "2024-01-10 10:00:00"), "s_time", "e_time")
    assert whole_hour[-1] == (t("10:00"), t("10:00"))
    times = ["04:59:59.999", "05:00", "07:59:59.999", "07:59:59.999500", "10:30", "10:30:00.000001"]
    df = spark.createDataFrame([(t(x),) for x in times], "at timestamp_ntz")
    assert [r[0] for r in rows(df.select(in_bucket(F.col("at"), "2024-01-10 10:30:00")))] == [False, True, True, False, True, False]


def test_span_hours_without_a_span_has_no_rows(spark):
    df = spark.createDataFrame([(t("08:50"), t("08:50")), (t("08:50"), None)], "a timestamp_ntz, b timestamp_ntz")
    gap = ceil_hours((hour_number(F.col("b")) - hour_number(F.col("a"))) * 3_600_000_000)
    assert rows(span_hours(df, gap, F.col("a"), F.col("b"))) == []


def test_span_hours_first_untruncated_last_ends_with_the_span(spark):
    df = spark.createDataFrame([(t("08:50"), t("10:10"))], "a timestamp_ntz, b timestamp_ntz")
    got = rows(span_hours(df, F.lit(2), F.col("a"), F.col("b")), "hour_seq", "start_time", "end_time")
    assert got == [(1, t("08:50"), t("08:59:59.999")), (2, t("09:00"), t("10:10"))]


def test_rounding_of_minutes_and_numbers(spark):
    minute = 60_000_000
    us = [0, 1, minute, minute + 1, -1, -minute - 1, 150_000_000, -150_000_000, 149_999_999]
    df = spark.createDataFrame([(x,) for x in us], "us bigint")
    got = rows(df.select(ceil_minutes(F.col("us")), round_minutes(F.col("us"))))
    assert got == [(0, 0), (1, 0), (1, 1), (2, 1), (0, 0), (-1, -1), (3, 3), (-2, -3), (3, 2)]
    numbers = spark.sql("select cast(x as decimal(20,6)) x from values ('12.6'), ('12.5'), ('-2.5'), ('12.4') as v(x)")
    assert [r[0] for r in rows(numbers.select(whole(F.col("x"))))] == [13, 13, -3, 12]


def test_container_length_classes(spark):
    df = spark.createDataFrame([(None,), ("22G1",), ("45G1",), ("L5G1",), ("",)], "iso string")
    assert [r[0] for r in rows(df.select(container_length(F.col("iso"))))] == [None, "20", "40", "40", "40"]


POINT = "tml_id string, eq_type string, eq_no string, day date, at timestamp_ntz, lo bigint, hi bigint, amount bigint"


def test_aggregates_inside_equal_brute_force(spark):
    import random

    rng = random.Random(7)
    units = ["E1", "E1", "E1", "E2"]
    moment = lambda: START + timedelta(microseconds=rng.choice([1, 250_000, 1_000_000, 60_000_000]) * rng.randrange(1400))
    points = [("T1", "YT", rng.choice(units), DAY, moment(), rng.randrange(1000), rng.randrange(1000), rng.randrange(100)) for _ in range(300)]
    cuts = set()
    for _ in range(120):
        a, b = moment(), moment()
        cuts.add(("T1", "YT", rng.choice(units), DAY, min(a, b), max(a, b)))
    cuts |= {("T1", "YT", "E1", DAY, START, END), ("T1", "YT", "E1", DAY, t("10:00"), t("09:00")), ("T1", "YT", "E3", DAY, START, END)}
    p = spark.createDataFrame(points, POINT)
    s = spark.createDataFrame(sorted(cuts), "tml_id string, eq_type string, eq_no string, day date, on_time timestamp_ntz, off_time timestamp_ntz")
    got = aggregate_inside(s, p, "at", {"a": ("min", "lo"), "b": ("max", "hi"), "c": ("sum", "amount")})
    expected = {}
    for cut in cuts:
        inside = [x for x in points if x[2] == cut[2] and cut[4] <= x[4] <= cut[5]]
        expected[cut] = (min(x[5] for x in inside), max(x[6] for x in inside), sum(x[7] for x in inside)) if inside else (None,) * 3
    assert {tuple(r[:6]): tuple(r[6:]) for r in rows(got)} == expected


def test_contained_intervals_keep_lonely_and_reversed_outer_rows(spark):
    outer_schema = "tml_id string, eq_type string, eq_no string, day date, on_time timestamp_ntz, off_time timestamp_ntz, n bigint"
    key = ("T1", "YT", "E1", DAY)
    outer = spark.createDataFrame(
        [(*key, t("08:00"), t("12:00"), 1), (*key, t("13:00"), t("14:00"), 1), (*key, t("16:00"), t("15:00"), 1)], outer_schema
    )
    inner = spark.createDataFrame(
        [(*key, t("08:00"), t("09:10")), (*key, t("11:00"), t("12:00")), (*key, t("11:30"), t("12:30"))],
        "tml_id string, eq_type string, eq_no string, day date, in_time timestamp_ntz, out_time timestamp_ntz",
    )
    got = rows(contains_interval(outer, inner), "on_time", "in_time", "out_time")
    assert sorted(got, key=str) == sorted(
        [(t("08:00"), t("08:00"), t("09:10")), (t("08:00"), t("11:00"), t("12:00")), (t("13:00"), None, None), (t("16:00"), None, None)],
        key=str,
    )


PIECE = "tml_id string, eq_type string, eq_no string, day date, on_time timestamp_ntz, off_time timestamp_ntz"


def test_containment_equals_its_condition_for_reversed_pieces_too(spark):
    import random

    rng = random.Random(11)
    moment = lambda: START + timedelta(minutes=rng.choice([1, 15, 60]) * rng.randrange(24))
    pieces = lambda n: sorted({("T1", "YT", rng.choice(["E1", "E2"]), DAY, moment(), moment()) for _ in range(n)})
    outer, inner = pieces(60), pieces(60)
    early = ("T1", "YT", "E1", DAY, t("10:00"), START - timedelta(days=40))  # open, and as_of lies weeks before
    inner.append(early)
    o = spark.createDataFrame(outer, PIECE)
    i = spark.createDataFrame(inner, PIECE).withColumnsRenamed({"on_time": "in_time", "off_time": "out_time"})
    expected = []
    for a in outer:
        found = [b for b in inner if b[2] == a[2] and a[4] <= b[4] and a[5] >= b[5]]
        expected += [(*a[2:], b[4], b[5]) for b in found] or [(*a[2:], None, None)]
    got = rows(contains_interval(o, i), "eq_no", "day", "on_time", "off_time", "in_time", "out_time")
    assert sorted(got, key=str) == sorted(expected, key=str)
