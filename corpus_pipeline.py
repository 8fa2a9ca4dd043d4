"""From documents to a training mix, stage by stage.

Each stage takes the documents that its predecessor kept and returns those that it keeps, with the same columns; the last
one returns them as often as the mix takes them, numbered in the column copy. Stages are written as Parquet in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymetrics.llm.common import stage as written
from quaymetrics.llm.decontaminate import drop_contaminated
from quaymetrics.llm.language_id import fit, keep_identified
from quaymetrics.llm.line_dedup import dedup_lines
from quaymetrics.llm.mixing import apply_mix
from quaymetrics.llm.simhash import drop_near_duplicates
from quaymetrics.session import prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages that the table names, learned from it, by half of their letters at least."""
    return keep_identified(docs, fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of three repeated lines."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark's items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for."""
    return apply_mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The learned language model, fingerprints and Newton steps have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = written(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
