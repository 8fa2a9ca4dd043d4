"""The operators of this subpackage as queries over the whole tables, and their DuckDB statements where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymetrics.llm import oracle
from quaymetrics.llm.chat import chat_report
from quaymetrics.llm.collocations import collocations
from quaymetrics.llm.decontaminate import contamination
from quaymetrics.llm.exact_dedup import equal_texts
from quaymetrics.llm.fill_in_middle import fim_report
from quaymetrics.llm.language_id import language_report
from quaymetrics.llm.line_dedup import line_report
from quaymetrics.llm.lm_score import lm_scores
from quaymetrics.llm.mixing import mix_report
from quaymetrics.llm.quality_classifier import quality_report, remainder
from quaymetrics.llm.quality_rules import quality_rules
from quaymetrics.llm.simhash import near_dedup_report
from quaymetrics.llm.suffix_dedup import suffix_report
from quaymetrics.session import prepare


#: A sentencepiece file with 32,000 pieces; every executor has the tokenizers' package installed.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The table and conversation -7, whose texts look like a template's control strings."""
    tricky = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": lambda s, d: suffix_report(table(s, d, "documents")),
    "op2_language_id": lambda s, d: language_report(table(s, d, "documents")),
    "op3_chat_format": lambda s, d: chat_report(conversations(s, d)),
    "op4_quality_rules": lambda s, d: quality_rules(table(s, d, "documents"), table(s, d, "labels")),
    "op5_decontamination": lambda s, d: contamination(table(s, d, "documents"), table(s, d, "benchmark")),
    "op6_line_dedup": lambda s, d: line_report(table(s, d, "documents")),
    "op7_simhash": lambda s, d: near_dedup_report(table(s, d, "documents")).drop("digest"),
    "op8_lm_score": lambda s, d: lm_scores(table(s, d, "documents"), remainder("doc_id", 7) == 2, VOCABULARY),
    "op9_mixing": lambda s, d: mix_report(table(s, d, "documents")),
    "op10_quality_classifier": lambda s, d: quality_report(table(s, d, "documents"), table(s, d, "labels")),
    "op11_collocations": lambda s, d: collocations(table(s, d, "documents")),
    "op12_fill_in_middle": lambda s, d: fim_report(table(s, d, "documents")),
    "op13_exact_dedup": lambda s, d: equal_texts(table(s, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op3_chat_format": oracle.CHAT_FORMAT,
    "op5_decontamination": oracle.DECONTAMINATION,
    "op6_line_dedup": oracle.LINE_DEDUP,
    "op11_collocations": oracle.COLLOCATIONS,
    "op12_fill_in_middle": oracle.FILL_IN_MIDDLE,
    "op13_exact_dedup": oracle.EXACT_DEDUP,
}
