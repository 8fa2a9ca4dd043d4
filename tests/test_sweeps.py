"""Sweeps over points and intervals against plain loops."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from conftest import plan_of, rows

from quaymetrics.operators.sweeps import aggregate_inside, envelope_inside

DAY = date(2024, 1, 10)
START = datetime(2024, 1, 10)
UNIT_DAY = "tml_id string, eq_type string, eq_no string, day date"
PIECE = f"{UNIT_DAY}, on_time timestamp_ntz, off_time timestamp_ntz"


def moments(rng, grain):
    return lambda: START + timedelta(microseconds=grain * rng.randrange(86_400_000_000 // grain))


@pytest.mark.parametrize("grain", [1, 60_000_000, 7_200_000_000])
@pytest.mark.parametrize("n", [1, 2, 7, 64, 500])
def test_aggregates_inside_equal_plain_loops(spark, grain, n):
    rng = random.Random(n + grain)
    moment = moments(rng, grain)
    units = ["E1", "E1", "E1", "E2"]
    points = [
        ("T1", "YT", rng.choice(units), DAY, moment(), rng.choice([None, rng.randrange(1000)]), rng.randrange(1000),
         rng.choice([None, Decimal(rng.randrange(10**9)) / 7]))
        for _ in range(n)
    ]
    points = [(*p[:7], None if p[7] is None else round(p[7], 12)) for p in points] + [("T1", "YT", "E1", DAY, None, 1, 1, Decimal(1))]
    asked = {("T1", "YT", rng.choice([*units, "E3"]), DAY, moment(), moment()) for _ in range(60)}
    asked |= {(*a[:4], min(a[4:]), max(a[4:])) for a in asked} | {("T1", "YT", "E1", DAY, None, START), ("T1", "YT", "E1", DAY, START, None)}
    p = spark.createDataFrame(points, f"{UNIT_DAY}, at timestamp_ntz, lo bigint, hi bigint, amount decimal(38,12)")
    i = spark.createDataFrame([(*a, k) for a in asked for k in (1, 2)], f"{PIECE}, label bigint")
    got = aggregate_inside(
        i, p, "at", {"first": ("min", "lo"), "most": ("max", "hi"), "last": ("max", "at"), "sum": ("sum", "amount")}, keep=["label"]
    )
    assert got.schema["sum"].dataType.simpleString() == "decimal(38,12)"

    def expected(cut):
        inside = [x for x in points if None not in (x[4], *cut[4:]) and x[2] == cut[2] and cut[4] <= x[4] <= cut[5]]
        amounts = [x[7] for x in inside if x[7] is not None]
        return (
            min((x[5] for x in inside if x[5] is not None), default=None), max((x[6] for x in inside), default=None),
            max((x[4] for x in inside), default=None), sum(amounts) if amounts else None,
        )

    found = rows(got)
    assert len(found) == len(asked) and all(r[6] == 2 for r in found)
    assert {tuple(r[:6]): tuple(r[7:]) for r in found} == {cut: expected(cut) for cut in asked}


@pytest.mark.parametrize("n", [0, 1, 2, 9, 200])
def test_envelopes_equal_plain_loops_reversed_ones_included(spark, n):
    rng = random.Random(n)
    moment = moments(rng, 600_000_000)
    inner = [("T1", "YT", rng.choice(["E1", "E1", "E2"]), DAY, moment(), moment()) for _ in range(n)]
    inner += [("T1", "YT", "E1", DAY, START, None)]
    outer = {("T1", "YT", rng.choice(["E1", "E2", "E3"]), DAY, moment(), moment()) for _ in range(80)}
    i = spark.createDataFrame(inner, PIECE).withColumnsRenamed({"on_time": "in_time", "off_time": "out_time"})
    got = envelope_inside(spark.createDataFrame(sorted(outer), PIECE), i)

    def expected(a):
        inside = [b for b in inner if b[2] == a[2] and b[5] is not None and a[4] <= b[4] and b[5] <= a[5]]
        return min((b[4] for b in inside), default=None), max((b[5] for b in inside), default=None)

    assert {tuple(r[:6]): tuple(r[6:]) for r in rows(got)} == {a: expected(a) for a in outer}


def test_a_sweep_is_one_shuffle_and_no_join(spark):
    p = spark.createDataFrame([("T1", "YT", "E1", DAY, START, 1, 2)], f"{UNIT_DAY}, at timestamp_ntz, lo bigint, amount bigint")
    i = spark.createDataFrame([("T1", "YT", "E1", DAY, START, START)], PIECE)
    for swept in (
        aggregate_inside(i, p, "at", {"a": ("min", "lo"), "b": ("sum", "amount"), "c": ("max", "at")}),
        envelope_inside(i, i.withColumnsRenamed({"on_time": "in_time", "off_time": "out_time"})),
    ):
        plan = plan_of(swept)
        assert plan.count("Exchange") == 1 and "Join" not in plan
