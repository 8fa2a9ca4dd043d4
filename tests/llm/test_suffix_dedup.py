from __future__ import annotations

import hashlib
import random

import numpy as np
from conftest import SF

from quaymetrics.llm import suffix_dedup
from quaymetrics.llm.suffix_dedup import LAST_ID, WINDOW, Levels, cut_repeats, suffix_report, suffixes


def brute(rows):
    """The contract, read row by row: doc_id says which row is earlier, of one doc_id (or none) the row that comes first."""
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (LAST_ID if rows[k][0] is None else rows[k][0], k))
    for place, k in enumerate(order):
        data, gone = (rows[k][1] or "").encode(), set()
        for s in range(len(data) - WINDOW + 1):
            if first.setdefault(data[s : s + WINDOW], (place, s)) < (place, s):
                gone.update(range(s, s + WINDOW))
        spans = sum(p - 1 not in gone for p in gone)
        rest = bytes(b for p, b in enumerate(data) if p not in gone)
        i = LAST_ID if rows[k][0] is None else rows[k][0]
        out.append((i, len(data), len(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def text(rng, n, letters="abcdefgh "):
    return "".join(rng.choice(letters) for _ in range(n))


def cases():
    rng = random.Random(3)
    passage, other = text(rng, 400), text(rng, 150)
    rows = [(i, text(rng, 80) + passage[rng.randrange(60) : 300 + rng.randrange(100)] + text(rng, 90)) for i in range(12)]
    rows += [(20 + i, other + text(rng, rng.randrange(200)) + other) for i in range(4)]
    rows += [(30, passage), (31, passage), (31, passage), (None, passage), (32, None), (33, ""), (34, "short"), (35, "é" * 90), (36, "é" * 90)]
    rows += [(40, "a" * 500), (41, "ab" * 300), (42, "xyz " * 200), (43, "q" * 99), (44, "q" * 100), (45, "q" * 101)]
    near = list(text(rng, 900))
    for i in range(50, 60):
        copy = near[:]
        for _ in range(4):
            copy[rng.randrange(len(copy))] = "Z"
        rows.append((i, "".join(copy)))
    return rows


def got(df):
    return sorted(((LAST_ID if r[0] is None else r[0], *r[1:]) for r in map(tuple, df.collect())), key=str)


def test_equals_brute_force(spark, make_docs):
    rows = cases()
    assert got(suffix_report(make_docs(rows).coalesce(1))) == brute(rows)  # rows of one doc_id in the order given
    unique = [r for k, r in enumerate(rows) if r[0] not in (None, 31)]
    assert got(suffix_report(make_docs(unique).repartition(3))) == brute(unique)


def test_rows_without_repeats_are_never_cut(spark, make_docs):
    """What is found in one row is not cut from another one of its doc_id, nor from other rows without a doc_id."""
    rng = random.Random(9)
    passage, clean, other = text(rng, 200), text(rng, 400), text(rng, 400)
    rows = [(1, passage), (None, clean), (None, passage + text(rng, 200)), (5, other), (5, passage + text(rng, 150)), (5, other), (None, clean)]
    out = cut_repeats(make_docs(rows).coalesce(1)).collect()
    kept = sorted(((r["doc_id"], len(r["kept"])) for r in out), key=str)
    assert kept == sorted([(1, 200), (None, 400), (None, 200), (5, 400), (5, 150), (5, 0), (None, 0)], key=str)
    assert got(suffix_report(make_docs(rows).coalesce(1))) == brute(rows)


def test_crowded_grams_are_compared_by_single_windows(spark, make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 2)
    rows = cases()
    assert got(suffix_report(make_docs(rows).coalesce(1))) == brute(rows)
    unique = [r for r in rows if r[0] not in (None, 31)]
    assert got(suffix_report(make_docs(unique).repartition(4))) == brute(unique)


def test_empty_table(spark, make_docs):
    assert suffix_report(make_docs([(1, "x")]).limit(0)).collect() == []


def test_outputs_of_the_operator(spark, make_docs):
    shared = text(random.Random(5), 200)
    out = {r["doc_id"]: r for r in cut_repeats(make_docs([(1, shared), (2, "head " + shared + " tail")])).collect()}
    assert bytes(out[1]["kept"]) == shared.encode() and out[1]["spans"] == []
    assert bytes(out[2]["kept"]) == b"head  tail" and [tuple(s) for s in out[2]["spans"]] == [(5, 205)]


def test_equal_windows_pick_the_same_place():
    rng = random.Random(8)
    shared = text(rng, 130).encode()
    found = []
    for _ in range(5):
        data = text(rng, 60).encode() + shared + text(rng, 60).encode()
        table, lo = suffixes(data, np.array([0]), np.array([1]), np.array([0]))
        places = set()
        for row, at in zip(table, lo, strict=True):
            places |= {(int(row["key"]), s - 60) for s in range(at, at + int(row["more"]) + 1) if 60 <= s <= 90}
        found.append(places)
    assert all(p == found[0] and len({s for _, s in p}) == 31 for p in found)


def test_levels_grow_geometrically_and_hold_each_context_once():
    rng, levels = np.random.default_rng(1), Levels()
    seen = {}
    for i in range(40):
        run = np.zeros(50, suffix_dedup.SUFFIX)
        run["key"], run["cls"] = rng.integers(0, 1 << 20, 50) << 30, rng.integers(0, 3, 50)
        run = run[np.unique(run[["key", "cls"]], return_index=True)[1]]
        run["doc"] = run["row"] = int(rng.integers(0, 1000))
        run["lo"] = i
        for r in run:
            at = (int(r["doc"]), int(r["lo"]))
            seen[int(r["key"]), int(r["cls"])] = min(seen.get((int(r["key"]), int(r["cls"])), at), at)
        levels.add(run)
        sizes = [len(level) for level in levels.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    every = np.concatenate(levels.levels)
    assert {(int(r["key"]), int(r["cls"])): (int(r["doc"]), int(r["lo"])) for r in every} == seen and len(every) == len(seen)


def test_smallest_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(suffix_report(docs)) == brute(rows)
