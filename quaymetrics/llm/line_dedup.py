"""Line dedup: windows of three consecutive lines; every occurrence of a window but its first one is removed.

A line is what stands between two line feeds, compared as it is. Lines of white space alone are not counted: a window
runs over three consecutive other lines. All windows are judged on the input. Of a repeated window the first occurrence
(smallest doc_id, then smallest position) stays; the positions that later ones cover are merged into runs, and a run goes
with the blank lines inside it. Windows are compared by two independent 64-bit hashes.

Defined cases: null and short texts have no window and stay as they are; a null doc_id sorts first; rows equal in
doc_id and text count as one document, so neither removes the other; other columns, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.common import BLANKS, row_key, same_row

WINDOW = 3


def _filled(line: Column) -> Column:
    return line.rlike(f"[^{BLANKS}]")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """One row a window: id, digest, its position among the filled lines, and its two hashes."""
    first = [F.col("a")[F.col("at") + i] for i in range(size)]
    second = [F.col("b")[F.col("at") + i] for i in range(size)]
    return (
        docs.where(F.col("text").isNotNull())
        .select(*row_key(), F.filter(_lines(F.col("text")), _filled).alias("lines"))
        .where(F.size("lines") >= size)
        .select(
            "id", "digest",
            F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
            F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
        )
        .select("id", "digest", "a", "b", F.explode(F.sequence(F.lit(0), F.size("a") - size)).alias("at"))
        .select("id", "digest", "at", F.xxhash64(*first).alias("k1"), F.xxhash64(F.lit(1), *second).alias("k2"))
    )


def _runs(docs: DataFrame, size: int) -> DataFrame:
    """Rows of documents that lose lines: id, digest, first and last filled line of each run."""
    found = _windows(docs, size)
    place = F.struct("id", "digest", "at")
    repeated = (
        found.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    later = found.join(repeated, ["k1", "k2"]).where(place > F.col("first"))
    at, last = F.col("at"), F.size("at") - 1
    starts = F.filter(at, lambda x, i: (i == 0) | (x - at[F.greatest(i - 1, F.lit(0))] > size))
    ends = F.filter(at, lambda x, i: (i == last) | (at[F.least(i + 1, last)] - x > size))
    return (
        later.groupBy("id", "digest").agg(F.sort_array(F.collect_set("at")).alias("at"))
        .select("id", "digest", starts.alias("starts"), F.transform(ends, lambda x: x + (size - 1)).alias("ends"))
    )


def _marked(docs: DataFrame, size: int) -> DataFrame:
    """The whole rows (row), what is left of their texts (kept), and counts of lines."""
    runs = _runs(docs, size)
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    joined = rows.join(runs, same_row(rows, runs), "left").select(
        "row", rows["id"], "starts", "ends", _lines(F.col("row.text")).alias("lines")
    )
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    found = joined.withColumn("filled", F.filter(numbers, lambda i: _filled(F.col("lines")[i])))
    # the lines before the first run, between runs, and after the last one
    start = lambda j: F.when(j == 0, 0).otherwise(F.col("filled")[F.col("ends")[F.greatest(j - 1, F.lit(0))]] + 1)
    end = lambda j: F.when(j == F.size("starts"), F.size("lines")).otherwise(
        F.col("filled")[F.col("starts")[F.least(j, F.size("starts") - 1)]]
    )
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("starts")), lambda j: F.slice("lines", start(j) + 1, end(j) - start(j))
    )
    lost = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0), lambda n, r: n + r["ends"] - r["starts"] + 1)
    return found.select(
        "row", "id",
        F.when(F.col("starts").isNull(), F.col("row.text")).otherwise(F.array_join(F.flatten(gaps), "\n")).alias("kept"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("filled")).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.when(F.col("starts").isNotNull(), F.size("starts")), F.lit(0)).cast("long").alias("n_runs"),
    )


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with repeated lines taken out of their texts; rows that lose their last filled line go."""
    left = _marked(docs, size).where("n_removed = 0 or n_removed < n_lines")
    return left.select(F.col("row").withField("text", F.col("kept")).alias("row")).select("row.*")


def line_report(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row: doc_id, filled lines, those removed, runs removed, and the digest of the remaining text."""
    kept = F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256)
    return _marked(docs, size).select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_runs", kept.alias("kept_sha256")
    )
