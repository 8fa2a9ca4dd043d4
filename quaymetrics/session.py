"""Session settings the reports rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Shuffles begin with so many parts, or with the session's own number where that is larger, and small ones are put together.
#: More than 200 would have their rows sorted in memory before they are written.
PARTS = 200


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results (zone, ANSI) and turn on the adaptive features the plans count on."""
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Bytes that a task reads of a shuffle. Sweeps sort their rows again and again, in about 45 times the bytes read: what a
        # task holds then no longer depends on the input, up to PARTS times as many bytes a shuffle.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        # hash instead of sort-merge joins where every build partition turns out this small
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
