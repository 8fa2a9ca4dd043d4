"""Shared pieces of the training-data operators: staged tables, word arrays, row keys."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class without its brackets.
BLANKS = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    `by` names a column that has a folder for each of its values.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a table of stage() that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {re.sub(r"(/[^/=]+=[^/]*)?/[^/]*$", "", file) for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of jobs that are done deleted: Spark does so once their tables are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII, where bytes equal characters, takes the quick way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column, separators: str = f"[{BLANKS}]+") -> Column:
    """The texts between separators, without empty ones; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def row_key(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """Columns id and digest: rows equal in both count as one document."""
    return [F.col(doc_id).alias("id"), F.xxhash64(text).alias("digest")]


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on row_key() that also matches null ids."""
    return left["id"].eqNullSafe(right["id"]) & (left["digest"] == right["digest"])


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so that workers need no installed copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
