from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from conftest import SF
from llm.test_decontaminate import brute as contaminated
from llm.test_line_dedup import brute as deduped
from llm.test_mixing import plain_targets
from llm.test_simhash import brute as near

import corpus_pipeline
from quaymetrics.llm import queries
from quaymetrics.llm.language_id import UND, fit, label_texts
from quaymetrics.llm.mixing import apply_mix, mix_report

FAST = ["op3_chat_format", "op5_decontamination", "op6_line_dedup", "op11_collocations", "op12_fill_in_middle", "op13_exact_dedup"]  # op1 has a brute-force test at this size


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([None if pd.isna(v) else v if isinstance(v, str) else float(v) for v in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_statements(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) and _rows(got) == _rows(duck.sql(queries.ORACLE_SQL[name]).df())


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {i: r["text"] for i, r in rows.items()}
    for name, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, SF)
        if name == "language_id":
            model = fit(spark.read.parquet(f"{SF}/documents.parquet"))
            langs, scores, _ = label_texts(model, list(kept.values()))
            kept = {i: t for (i, t), lang, s in zip(kept.items(), langs, scores, strict=True) if lang != UND and s >= 0.5}
        elif name == "line_dedup":
            kept = {i: t for i, n, gone, _, _, t in deduped(list(kept.items())) if gone == 0 or gone < n}
        elif name == "near_dedup":
            kept = {i: kept[i] for i, _, c in near(list(kept.items())) if i == c}
        elif name == "decontamination":
            kept = {r[0]: kept[r[0]] for r in contaminated(list(kept.items()), benchmark) if not r[-1]}
        if name != "mixing":
            assert docs.columns == columns
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept and kept
    out = docs.collect()
    assert docs.columns == [*columns, "copy"] and {r["doc_id"] for r in out} <= kept.keys()
    assert all(r["text"] == kept[r["doc_id"]] for r in out)
    sizes: dict = {}
    for i, t in kept.items():
        sizes[rows[i]["source"]] = sizes.get(rows[i]["source"], 0) + len(t.encode().split())
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        taken[r["source"]] += len(r["text"].encode().split())
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= max(100, 0.05 * target)  # ten documents a source


def test_run_writes_every_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "copy" in out.columns


def test_no_stage_keeps_rows_repeated_whole(spark, make_docs):
    """Rows repeated whole, equal texts under one id or none: one stays, and the mix takes what it decided."""
    text = " ".join(f"word{k}" for k in range(12))
    rows = [(7, text)] * 3 + [(None, text)] * 2 + [(9, text), (9, "another text here"), (None, "only text without a number")]
    rows += [(20 + i, " ".join(f"{i}w{k * k % 7}x{k}" for k in range(30))) for i in range(10)]
    left = corpus_pipeline.near_dedup(spark, make_docs(rows).repartition(3), "")
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(
        {(7, text), (9, "another text here"), (None, "only text without a number"), *rows[8:]}, key=str
    )


def test_the_mix_takes_what_it_decided_of_equal_rows(spark, make_docs):
    rows = [(7, "a b c d e f")] * 5 + [(None, "g h i")] * 4 + [(30 + i, "x " * (i + 1)) for i in range(9)]
    docs = make_docs(rows)
    decided = sum(r["taken"] for r in mix_report(docs, weights=(1,), share=0.7).collect())
    mixed = apply_mix(docs, weights=(1,), share=0.7).collect()
    assert sum(len(r["text"].split()) for r in mixed) == decided
    assert abs(decided - 0.7 * sum(len(t.split()) for _, t in rows)) <= 2
