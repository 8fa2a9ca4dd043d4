"""The key/value configuration table: listing, changing, pivoting."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SCHEMAS
from .tables import Scope, Tables, scoped

# Setting names and the output column each one feeds.
SETTINGS = {
    "SCH_DOWN": "sch_down_time_min",
    "USCH_DOWN": "unsch_down_time_min",
    "TML_CLOSE": "tml_close_min",
    "OFFLINE_OPR_DELAY": "offline_opr_delay_min",
    "TOS_FAILURE_ONLINE": "tos_failure_online_min",
    "ONLINE_DOWN": "online_down_time_min",
    "OTHER_IDLE": "other_idle_time_min",
}


def _match(tml_id: str | None, gp: str | None, eq_type: str | None):
    cond = F.lit(True)
    for column, wanted in (("bi_ov_tml_id", tml_id), ("bi_ov_tml_gp", gp), ("bi_ov_eq_type", eq_type)):
        if wanted is not None:
            cond = cond & (F.col(column) == wanted)
    return cond


def oee_config_list(
    tables: Tables, gp: str | None = None, tml_id: str | None = None, eq_type: str | None = None
) -> DataFrame:
    """Configuration rows of a terminal, group and equipment type, by sequence."""
    rows = tables.bi_oee_tml_value.where(_match(tml_id, gp, eq_type))
    return rows.orderBy("bi_ov_tml_id", "bi_ov_tml_gp", "bi_ov_eq_type", "bi_ov_value_seq")


def oee_config_set(
    tables: Tables,
    value_type: str,
    value: str,
    gp: str | None = None,
    tml_id: str | None = None,
    eq_type: str | None = None,
) -> DataFrame:
    """The whole table with one setting changed where all keys match; write it as the next snapshot."""
    hit = _match(tml_id, gp, eq_type) & (F.col("bi_ov_value_type") == value_type)
    return tables.bi_oee_tml_value.withColumn("bi_ov_value", F.when(hit, F.lit(value)).otherwise(F.col("bi_ov_value")))


class StaleSettings(RuntimeError):
    """The settings have changed since they were read."""


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def settings_version(spark: SparkSession, root: str) -> int:
    """Number of the current snapshot under root; 0 before the first one."""
    fs, folder = _folder(spark, root)
    found = [0]
    if fs.exists(folder):
        found += [int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(folder)]
    return max(found)


def read_settings(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The current snapshot and its number, to be given to publish_settings()."""
    version = settings_version(spark, root)
    if not version:
        raise FileNotFoundError(f"no settings under {root}")
    return spark.read.schema(SCHEMAS["bi_oee_tml_value"]).parquet(f"{root}/snapshot-{_snapshot(spark, root, version)}"), version


def _snapshot(spark: SparkSession, root: str, version: int) -> str:
    fs, folder = _folder(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    return next(n.split("-")[1] for n in names if int(n.split("-")[0]) == version)


def publish_settings(settings: DataFrame, root: str, base: int) -> int:
    """Make settings the next snapshot after number `base` and return its number; readers see all of it or nothing.

    The rows are written to a folder of their own first. Then the number is taken by creating its file, which the file
    system grants once; StaleSettings if somebody else has published since `base` was read. A publisher that dies after that
    leaves its number in `_taken` without a version: delete that file to go on.
    """
    spark = settings.sparkSession
    if settings_version(spark, root) != base:
        raise StaleSettings(f"snapshot {base} is not the current one")
    name = uuid.uuid4().hex
    settings.write.parquet(f"{root}/snapshot-{name}")
    fs, folder = _folder(spark, root)
    fs.mkdirs(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        fs.create(path(f"{root}/_taken/{base + 1:09d}"), False).close()
    except Py4JJavaError as error:
        raise StaleSettings(f"snapshot {base + 1} was published by somebody else") from error
    fs.create(path(f"{root}/_versions/{base + 1:09d}-{name}"), False).close()
    return base + 1


def pivot_config(tables: Tables, scope: Scope) -> DataFrame:
    """One row per terminal and equipment type, the largest value over groups per setting, 0 where unset."""
    value = F.col("value").cast("decimal(20,6)")
    picked = [
        F.coalesce(F.max(F.when(F.col("value_type") == name, value)), F.lit(0)).alias(column)
        for name, column in SETTINGS.items()
    ]
    wanted = F.col("bi_ov_value_type").isin(*SETTINGS)
    return scoped(tables, "bi_oee_tml_value", scope, wanted).groupBy("tml_id", "eq_type").agg(*picked)
