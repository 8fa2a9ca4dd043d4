"""Sequence numbers within groups, without putting a large group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, *buckets: Column) -> DataFrame:
    """Add `name`: 1, 2, ... within each group by `order`, NULLs first. Rows equal in all of `order` may swap.

    `buckets` split a group over many tasks, from coarse to fine. Each must rise with the leading column of `order`, never
    falling along it, NULL first. Rows are numbered per group and finest bucket, then raised by the rows that the group has
    in earlier buckets: a running count over the buckets within the next coarser one, and so on. Without buckets a group is
    one task's: for groups that cannot be large.
    """
    if not buckets:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*_order(order))).cast("bigint"))
    # a struct is never NULL, and NULLs in two of them are equal: one key for the window and the join
    levels = [f"_b{k}" for k in range(len(buckets))]
    key = F.struct(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], *[b.alias(n) for b, n in zip(buckets, levels)])
    bucket = W.partitionBy("_key")
    rows = df.withColumn("_key", key).withColumns({
        "_local": F.row_number().over(bucket.orderBy(*_order(order))), "_size": F.count("*").over(bucket),
    })
    # One row a bucket goes on. The second condition always holds: it asks for every column, so that both uses of the rows
    # read the same shuffle.
    first = rows.where((F.col("_local") == 1) & (F.xxhash64(*df.columns) % 2 < 2))
    sizes = first.select("_key", "_size", "_key.*")
    before = _before(sizes, [f"_g{k}" for k in range(len(group))], levels)
    number = (F.col("_local") + F.col("_before")).cast("bigint").alias(name)
    return rows.join(before, "_key").select(*df.columns, number)


def _before(sizes: DataFrame, group: list[str], levels: list[str]) -> DataFrame:
    """_key and how many rows the group has in earlier buckets."""
    *coarser, finest = [*group, *levels]
    earlier = W.partitionBy(*coarser).orderBy(F.col(finest).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    counted = sizes.withColumn("_earlier", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    if len(levels) == 1:
        return counted.select("_key", F.col("_earlier").alias("_before"))
    inside = counted.withColumn("_outer", F.struct(*coarser))
    outer = inside.groupBy("_outer").agg(F.sum("_size").alias("_size")).select(F.col("_outer").alias("_key"), "_size", "_outer.*")
    further = _before(outer, group, levels[:-1]).withColumnsRenamed({"_key": "_outer", "_before": "_further"})
    return inside.join(further, "_outer").select("_key", (F.col("_earlier") + F.col("_further")).alias("_before"))
