from __future__ import annotations

import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quaymetrics.llm import quality_classifier as q


@pytest.fixture(scope="module")
def tables(spark):
    folder = SF.replace("sf0.001", "sf0.1")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = q.quality_report(docs, labels).collect()
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)
    usual = sum(truth[r["doc_id"]] for r in held) / len(held)
    assert right > 0.95 > usual
    # calibrated: scores add up to about as many good texts as there are
    assert abs(sum(r["score"] for r in held) / len(held) - usual) < 0.05


def test_held_out_labels_teach_nothing(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(q.remainder("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(str, q.quality_report(docs, la).collect())) for la in (labels, turned))
    assert one == two


def test_edge_rows(spark, make_docs):
    rows = [(i, ("good plain words here " if i % 2 else "BAD!! STUFF!! ") * (i % 9 + 2)) for i in range(90)]
    rows += [(200, None), (201, ""), (203, "x"), (203, "x"), (None, "good plain words here"), (204, "good " * 40_000)]
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(90)] + [(None, 1, 0), (3, None, 0), (5, 1, 0), (5, 1, 1), (777, 0, 0), (200, 1, 0)], "doc_id long, quality int, toxic int"
    )
    out = q.quality_report(make_docs(rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 90]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    assert q.quality_report(make_docs(rows).limit(0), labels).collect() == []
    few = q.quality_report(make_docs(rows), labels.where("quality = 1")).collect()
    assert {r["score"] for r in few} == {1.0}
    assert {r["score"] for r in q.quality_report(make_docs(rows), labels.limit(0)).collect()} == {0.5}
