"""Points and intervals inside intervals of the same unit and day, by sweeps in order of time.

A sweep puts points and the bounds of intervals into one order per unit and day and carries running counts and sums along.
All steps of a sweep share one shuffle: they only sort the rows of a unit's day again. No row meets another one in a join.

Least and greatest values have no differences. Points are therefore numbered, and each is copied once for each level of
doubling blocks of numbers, as many as its unit's day has. A range of numbers is the end of one block and the beginning of
the next one on the level of the highest bit in which its bounds differ, so two running values give its answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.timeops import micros
from .spine import UNIT

UNIT_DAY = [*UNIT, "day"]
FRAME = [*UNIT_DAY, "on_time", "off_time"]

_BEGIN, _POINT, _END = 0, 1, 2  # in this order at one instant: bounds are inside
_EXTREMES = {"min": F.min, "max": F.max}


def _is(kind: int) -> Column:
    return F.col("_kind") == kind


#: Rows are sorted by a number for the unit and day first: nearly all comparisons end there, without looking at the texts.
_GROUP = ["_unit", *UNIT_DAY]


def _running(*partition: str) -> W:
    return W.partitionBy(*_GROUP, *partition).rowsBetween(W.unboundedPreceding, W.currentRow)


def _bit_length(x: Column) -> Column:
    return F.length(F.bin(x))


def _numbered(rows: DataFrame) -> DataFrame:
    """In order of _t and _kind: how many points up to here (_n), and how many in the unit's day (_total)."""
    point = F.when(_is(_POINT), F.lit(1))
    return rows.withColumn("_unit", F.xxhash64(*UNIT_DAY)).withColumns({
        "_n": F.count(point).over(_running().orderBy("_t", "_kind")),
        "_total": F.count(point).over(W.partitionBy(*_GROUP)),
    })


def aggregate_inside(
    intervals: DataFrame,
    points: DataFrame,
    at: str,
    aggregates: dict[str, tuple[str, str]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """For each distinct interval [on_time, off_time], aggregates over the points of its unit and day inside it.

    `aggregates` maps an output name to (min | max | sum, point column), each column used once; the column may be `at`
    itself. Intervals without points, reversed ones and such without a bound get NULLs; `keep` names interval columns to
    carry along, the largest value of equal intervals.
    """
    functions = {column: fn for fn, column in aggregates.values()}
    if len(functions) < len(aggregates):
        raise ValueError("each point column can be aggregated once")
    last = functions.get(at) == "max"  # the last point before the end, if it lies inside
    sums = [c for c, fn in functions.items() if fn == "sum"]
    extremes = {c: _EXTREMES[fn] for c, fn in functions.items() if fn != "sum" and not (last and c == at)}

    found = points.where(F.col(at).isNotNull()).select(
        *UNIT_DAY, micros(F.col(at)).alias("_t"), F.lit(_POINT).alias("_kind"), *[F.col(c).alias(f"_v_{c}") for c in functions]
    )
    bounds = F.array(*[
        F.struct(micros(F.col(c)).alias("t"), F.lit(kind).alias("kind")) for c, kind in (("on_time", _BEGIN), ("off_time", _END))
    ])
    asked = intervals.select(*FRAME, *keep, F.explode(bounds).alias("_bound"))
    asked = asked.select(*FRAME, *keep, F.col("_bound.t").alias("_t"), F.col("_bound.kind").alias("_kind"))
    rows = _numbered(found.unionByName(asked, allowMissingColumns=True))

    in_order = _running().orderBy("_t", "_kind")
    for c in sums:
        rows = rows.withColumns({f"_s_{c}": F.sum(f"_v_{c}").over(in_order), f"_n_{c}": F.count(f"_v_{c}").over(in_order)})
    if last:
        rows = rows.withColumn(f"_m_{at}", F.max(f"_v_{at}").over(in_order))
    if extremes:
        rows = _with_extremes(rows, extremes)

    sides = {c: rows.schema[f"_s_{c}"].dataType for c in sums}
    known = F.col("on_time").isNotNull() & F.col("off_time").isNotNull()
    some = known & (F.max(F.when(_is(_END), F.col("_n"))) > F.max(F.when(_is(_BEGIN), F.col("_n"))))

    def result(name: str, fn: str, c: str) -> Column:
        if fn == "sum":
            n = F.max(F.when(_is(_END), F.col(f"_n_{c}"))) - F.max(F.when(_is(_BEGIN), F.col(f"_n_{c}")))
            total = _difference(F.coalesce(f"_s_{c}", F.lit(0)), sides[c])
            return F.when(some & (n > 0), total).alias(name)
        if last and c == at:
            return F.when(some, F.max(F.when(_is(_END), F.col(f"_m_{c}")))).alias(name)
        return F.when(some, _EXTREMES[fn](f"_m_{c}")).alias(name)

    results = [result(name, fn, c) for name, (fn, c) in aggregates.items()]
    return rows.where(~_is(_POINT)).groupBy("_unit", *FRAME).agg(*[F.max(c).alias(c) for c in keep], *results).drop("_unit")


def _difference(running: Column, kind) -> Column:
    """What a running sum grew by from the begin to the end, in its own type."""
    if isinstance(kind, DecimalType) and kind.precision == 38:  # one digit of room, else the difference loses one of its scale
        running = running.cast(DecimalType(37, kind.scale))
    grown = F.max(F.when(_is(_END), running)) - F.max(F.when(_is(_BEGIN), running))
    return grown.cast(kind)


def _with_extremes(rows: DataFrame, extremes: dict) -> DataFrame:
    """_m_<column>: on both bounds of an interval, the extreme of the points on its side of the border between two blocks."""
    mine = W.partitionBy(*_GROUP, "on_time", "off_time")
    rows = rows.withColumns({
        "_from": F.min(F.when(_is(_BEGIN), F.col("_n") + 1)).over(mine), "_to": F.max(F.when(_is(_END), F.col("_n"))).over(mine),
    })
    first, to = F.col("_from"), F.col("_to")
    # a lone point is a block of its own on the lowest level; -1 for nothing to look up
    level = F.when(first > to, -1).when(first == to, 0).otherwise(_bit_length(first.bitwiseXOR(to)) - 1)
    levels = F.when(_is(_POINT), F.sequence(F.lit(0), _bit_length(F.col("_total")) - 1)).otherwise(F.array(F.coalesce(level, F.lit(-1))))
    place = F.when(_is(_BEGIN), first).otherwise(F.when(_is(_END), to).otherwise(F.col("_n")))
    rows = rows.withColumn("_place", place).withColumn("_level", F.explode(levels))
    rows = rows.withColumn("_block", F.when(F.col("_level") >= 0, F.expr("shiftright(_place, _level)")).otherwise(0))
    # towards the border: from the end of an even block back, from the beginning of an odd one on
    away = F.when(F.col("_block") % 2 == 1, F.col("_place")).otherwise(-F.col("_place"))
    near = _running("_level", "_block").orderBy("_away", ~_is(_POINT))
    found = {f"_m_{c}": F.when(F.col("_level") >= 0, fn(f"_v_{c}").over(near)) for c, fn in extremes.items()}
    return rows.withColumn("_away", away).withColumns(found)


def envelope_inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """For each distinct interval of `outer`, the least in_time and the greatest out_time of the inner ones inside it.

    Inside is on_time <= in_time and out_time <= off_time, so that either may be reversed. first_in and last_out are NULL
    where there is none.

    The inner ones are numbered by in_time. Those that begin late enough are all from some number on: blocks of doubling
    size, in each of which a sweep by out_time carries the two values.
    """
    found = inner.where(F.col("in_time").isNotNull() & F.col("out_time").isNotNull()).select(
        *UNIT_DAY, micros(F.col("in_time")).alias("_t"), F.lit(_POINT).alias("_kind"), micros(F.col("out_time")).alias("_end")
    )
    asked = outer.select(
        *FRAME, micros(F.col("on_time")).alias("_t"), F.lit(_BEGIN).alias("_kind"), micros(F.col("off_time")).alias("_end")
    )
    rows = _numbered(found.unionByName(asked, allowMissingColumns=True))
    rows = rows.withColumn("_size", F.expr("shiftleft(1L, length(bin(_total)))"))
    # what is left from the number after _n to the end, as a sum of powers of two: one block for each of its bits
    left = F.when(F.col("_t").isNotNull() & F.col("_end").isNotNull(), F.col("_size") - 1 - F.col("_n")).otherwise(0)
    rows = rows.withColumn("_left", left).withColumn("_level", F.explode(F.sequence(F.lit(0), _bit_length(F.col("_total")) - 1)))
    asks = F.expr("shiftright(_left, _level) % 2 = 1")
    rows = rows.withColumn("_asks", asks).where(_is(_POINT) | F.col("_asks") | (F.col("_level") == 0))
    begins = F.when(_is(_POINT), F.col("_n")).otherwise(F.col("_size") - F.expr("shiftleft(shiftright(_left, _level), _level)"))
    rows = rows.withColumn("_begins", begins).withColumn("_block", F.expr("shiftright(_begins, _level)"))
    near = _running("_level", "_block").orderBy("_end", ~_is(_POINT))
    values = {
        "_first": F.min(F.when(_is(_POINT), F.col("_t"))).over(near), "_last": F.max(F.when(_is(_POINT), F.col("_end"))).over(near),
    }
    swept = rows.withColumns(values).where(_is(_BEGIN)).withColumns(
        {c: F.when(F.col("_asks"), F.col(c)) for c in values}
    )

    def moment(us: Column, name: str) -> Column:
        return F.timestamp_micros(us).cast("timestamp_ntz").alias(name)

    swept = swept.groupBy("_unit", *FRAME).agg(moment(F.min("_first"), "first_in"), moment(F.max("_last"), "last_out"))
    return swept.drop("_unit")
