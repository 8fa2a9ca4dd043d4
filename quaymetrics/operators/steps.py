"""JSON arrays to rows. Each column is parsed and exploded once; NULL, empty and unreadable arrays give no row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import whole
from ..sources.schema import LEG_JSON, STEP_FIELDS, parsed, step_json


def explode_steps(df: DataFrame, column: str, *fields: str, outer: bool = False) -> DataFrame:
    """One row per step of a cycle or event array, with the step columns named (all four by default).

    They are interval_sec, activity_type, step_dist and laden_status. With `outer` an array without steps gives a row too, and
    step_no, the array position, is NULL there.
    """
    fields = fields or tuple(STEP_FIELDS)
    others = [c for c in df.columns if c != column]
    array = parsed(df, column, step_json(*fields))
    rows = df.select(*others, F.posexplode_outer(array).alias("step_no", "step") if outer else F.explode(array).alias("step"))
    return rows.select(*others, *["step_no"] * outer, *[F.col(f"step.{STEP_FIELDS[f][0]}").alias(f) for f in fields])


def explode_legs(df: DataFrame, column: str = "trv_with_eta", outer: bool = False) -> DataFrame:
    """One row per travel leg; distances and times become whole numbers leg by leg. leg_no is the array position.

    With `outer` an array without legs gives a row too, without leg_no.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    others = [c for c in df.columns if c != column]
    rows = df.select(*others, explode(parsed(df, column, LEG_JSON)).alias("leg_no", "leg"))
    return rows.select(
        *others,
        "leg_no",
        F.col("leg.fromStep").alias("from_step"),
        F.col("leg.toStep").alias("to_step"),
        whole(F.col("leg.etaDistance")).alias("eta_distance"),
        whole(F.col("leg.ataDistance")).alias("ata_distance"),
        whole(F.col("leg.etaTimeSec")).alias("eta_time_sec"),
        whole(F.col("leg.ataTimeSec")).alias("ata_time_sec"),
    )


def sum_of(array: str, value: Callable[[Column], Column]) -> Column:
    """SUM of value over an array's elements within the row: NULLs are left out, NULL if there is nothing else."""
    values = F.filter(F.transform(array, lambda x: value(x).cast("decimal(38,12)")), lambda v: v.isNotNull())
    zero = F.lit(0).cast("decimal(38,12)")
    total = F.aggregate(values, zero, lambda total, v: (total + v).cast("decimal(38,12)"))
    return F.when(F.exists(array, lambda x: value(x).isNotNull()), total)
