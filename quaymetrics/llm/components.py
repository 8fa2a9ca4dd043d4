"""Connected components over links between 64-bit keys, as rounds of Spark joins.

Alternates two steps that keep connectivity and pull every key towards the least of its component: large stars (every
larger neighbour of a key is linked to the least one it knows) and small stars (the same among smaller neighbours). The
rounds needed grow with the logarithm of the number of keys, not with the length of chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.common import stage, unstage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # links point from the larger to the smaller key
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["x"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """links: columns u and v (long). Returns key, root: for every linked key the least key that it reaches.

    Keys that have no link, or one to themselves only, are not listed.
    """
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now = stage(pairs, "links")
    before = None
    # one row (a count and two checksums of the links) comes to the driver each round
    while (state := _state(now)) != before:
        before = state
        after = stage(_small_star(_large_star(now)), "links")
        unstage(now)
        now = after
    return now.select(F.col("u").alias("key"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    )
