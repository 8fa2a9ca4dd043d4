from __future__ import annotations

import hashlib
import random

from quaymetrics.llm.line_dedup import dedup_lines, line_report


def brute(rows):
    """rows: (doc_id, text), no null ids but ties; rows equal in both are one document."""
    first, docs = {}, []
    for i, t in rows:
        raw = None if t is None else t.split("\n")
        filled = [k for k, line in enumerate(raw or []) if line.strip(" \t\n\r\x0b\x0c")]
        docs.append((i, t, raw, filled))
        for p in range(len(filled) - 2):
            w = tuple(raw[filled[p + k]] for k in range(3))
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, t, raw, filled in docs:
        gone = set()
        for p in range(len(filled) - 2):
            if first[tuple(raw[filled[p + k]] for k in range(3))] < (i, p):
                gone |= {p, p + 1, p + 2}
        runs = [p for p in gone if p - 1 not in gone]
        dead = {k for k in range(len(raw or [])) for p in gone if k == filled[p] or (p + 1 in gone and filled[p] < k < filled[p + 1])}
        kept = t if not gone else "\n".join(line for k, line in enumerate(raw) if k not in dead)
        out.append((i, len(filled), len(gone), len(runs), hashlib.sha256((kept or "").encode()).hexdigest(), kept))
    return out


def cases():
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " \t", "c\r"]) for _ in range(rng.randrange(14)))) for i in range(60)]
    rows += [(100, "x\ny\nz"), (101, "x\ny\nz"), (101, "x\ny\nz"), (102, "x\n\ny\n\nz\nw"), (103, "q\nx\ny\nz\n"), (104, None), (105, ""), (106, "x\ny")]
    rows += [(200, "\n".join(f"long {k}" for k in range(4000))), (201, "\n".join(f"long {k}" for k in range(10, 3000)) + "\nend")]
    return rows


def test_equals_brute_force(spark, make_docs):
    rows = cases()
    got = sorted(map(tuple, line_report(make_docs(rows).repartition(3)).collect()))
    assert got == sorted(r[:5] for r in brute(rows))


def test_rows_keep_their_columns_and_emptied_rows_go(spark, make_docs):
    rows = cases()
    docs = make_docs(rows)
    kept = dedup_lines(docs)
    assert kept.columns == docs.columns
    expected = [(i, text) for i, n, gone, _, _, text in brute(rows) if gone == 0 or gone < n]
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in expected)


def test_null_ids_come_first_and_empty_tables_stay_empty(spark, make_docs):
    got = {r["doc_id"]: r["n_removed"] for r in line_report(make_docs([(1, "a\nb\nc"), (None, "a\nb\nc")])).collect()}
    assert got == {1: 3, None: 0}
    assert line_report(make_docs([(1, "a")]).limit(0)).collect() == []
