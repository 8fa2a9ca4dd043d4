from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quaymetrics.llm import fill_in_middle as m


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in m.SENTINELS) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, "spm" if spm else "psm", a, b - a, sha(output), sha(text))


def cases():
    rng = random.Random(12)
    shared = "".join(rng.choice("abc é中😀\n") for _ in range(3000))
    rows = [(i, "".join(rng.choice("ab é中😀<>PSM") for _ in range(rng.randrange(400)))) for i in range(150)]
    rows += [(200 + i, rng.choice(["x", "é"]) * i + shared + str(i)) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "<P>"), (303, "a<S"), (303, "a<S"), (303, "other"), (None, "no id"), (None, None), (-7, "中" * 50_000), (304, "x" * 200_000), (305, "a" * 30_000 + "<M>" + "b")]
    return rows


def test_equals_brute_force(spark, make_docs):
    rows = cases()
    got = m.fim_report(make_docs(rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute(*r) for r in rows), key=str)


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, m.fim_report(docs).collect()))
    assert got == sorted(brute(r["doc_id"], r["text"]) for r in docs.collect())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_keeps_other_columns_and_reads_outputs_back(spark, make_docs):
    docs = make_docs(cases()).withColumn("fim", F.lit("replaced"))
    out = m.fill_in_middle(docs, sentinels=("[pre]", "{suf}", "(mid)"), rate=100, suffix_first=50, seed=3)
    assert out.columns == docs.columns
    rows = out.select("text", "source", "fim.*", m.restored(F.col("fim.output"), F.col("fim.form"), ("[pre]", "{suf}", "(mid)")).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") and r["source"] == "s" for r in rows)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        if r["form"] == "psm":
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            assert r["output"] == f"[pre]{r['text'][:a]}{{suf}}{r['text'][b:]}(mid){r['text'][a:b]}"


def test_rejects_sentinels_that_could_arise_across_a_border(spark, make_docs):
    for bad in (("aa", "b", "c"), ("<P>", "<P>", "<M>"), ("<P", "S<", "M")):
        with pytest.raises(ValueError):
            m.fill_in_middle(make_docs([(1, "x")]), sentinels=bad)


def test_no_documents(spark, make_docs):
    assert m.fim_report(make_docs(cases()).limit(0)).collect() == []


def rolled(data):
    """The rolling hash, a byte at a time."""
    value, out = 0, []
    for k, byte in enumerate(data):
        value = (value << 1) + int(m._GEAR[byte])
        if k >= m.WINDOW:
            value -= int(m._GEAR[data[k - m.WINDOW]]) << m.WINDOW
        out.append(value & 0xFFFFFFFF)
    return out


def test_cut_places_are_those_of_the_rolling_hash_whatever_the_strips(monkeypatch):
    data = np.frombuffer(random.Random(3).randbytes(20_000), np.uint8)
    expected = [k + 1 for k, v in enumerate(rolled(data.tolist())) if k >= m.WINDOW and not v & int(m._MASK)]
    for strip in (m.STRIP, 1000, 17):
        monkeypatch.setattr(m, "STRIP", strip)
        assert [p for p in m.cut_places(data).tolist() if p > m.WINDOW] == expected


def test_chunks_of_a_shared_passage_are_the_same_and_looked_up():
    rng = random.Random(4)
    passage = rng.randbytes(40_000)
    memo = m.ChunkMemo([b"<P>", b"<S>", b"<M>"])

    def chunks(data):
        places = m.cut_places(np.frombuffer(data, np.uint8)).tolist()
        ends = m.chunk_ends(places, 0, len(data))
        assert ends[-1] == len(data) and all(b - a <= m.MOST for a, b in zip([0, *ends], ends))
        m.ChunkedText(memoryview(data), 0, ends, memo)
        return {data[a:b] for a, b in zip([0, *ends], ends)}

    first, met = chunks(rng.randbytes(777) + passage), memo.hits
    second = chunks(rng.randbytes(1234) + passage)
    assert len(first & second) > 0.9 * len(second) and memo.hits - met >= len(first & second)


def test_memo_is_bounded_and_compares_contents(monkeypatch):
    memo = m.ChunkMemo([b"<P>"], limit=1000)
    for k in range(50):
        memo.summary(bytes([k]) * 100)
    assert memo.bytes <= 1000 and len(memo.held) == 10
    monkeypatch.setattr(m.xxhash, "xxh3_64_intdigest", lambda data: 1)
    memo = m.ChunkMemo([b"<P>"])
    assert [memo.summary(x).points for x in (b"abc", b"\xc3\xa9", b"abc", b"x<P>")] == [3, 1, 3, 4]
    assert memo.hits == 1 and memo.summary(b"x<P>").holds
