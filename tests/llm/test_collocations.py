from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import pytest
from conftest import SF

from quaymetrics.llm import collocations as c


def brute(rows, least=10, longest=3, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for size in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {
            p[i : i + size]
            for p, b in candidates.items() for size in range(2, len(p)) for i in range(len(p) - size + 1)
            if 100 * b >= 50 * counts[p[i : i + size]]
        }
        ranked = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def docs_of(spark, rows):
    full = [(i, text, lang, "s", 1, "x", 2, 3) for i, (lang, text) in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n long, phrase string, size int, slot int")


def cases():
    rng = random.Random(11)
    words = ["Ab", "ab", "cd", "é", "x-y", "\x0bz", "q"]
    rows = [("en" if i % 3 else None, "".join(rng.choice(words) + rng.choice([" ", "\t", "  ", ", ", ".", "\n"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [("en", None), ("en", ""), ("en", " ... "), ("und", "ab cd é"), ("de", "nur wenig"), ("de", "a a a a a a a a a a a a a a")]
    rows += [("fr", "hot pair here")] * 40 + [("fr", "hot pair"), ("fr", "pair here pair")]
    numbered = [(i % 50, r) for i, r in enumerate(rows)] + [(None, ("en", "ab cd ab cd ab cd")), (None, ("en", "ab cd ab cd ab cd"))]
    return numbered


@pytest.mark.parametrize("how", [{}, {"shards": 1}, {"shards": 7, "slot_bits": 6}, {"shards": 3, "block": 40}, {"longest": 2}, {"longest": 5, "shards": 2, "block": 64}])
def test_equals_brute_force(spark, how):
    rows = cases()
    got = c.collocations(docs_of(spark, rows).repartition(3), **how)
    longest = how.get("longest", 3)
    assert sorted(map(tuple, got.collect())) == brute([r for _, r in rows], longest=longest)


def test_each_language_has_its_first_ones_in_order(spark):
    rows = cases()
    got = sorted(map(tuple, c.collocations(docs_of(spark, rows), least=2, top=4).collect()))
    assert got == brute([r for _, r in rows], least=2, top=4)
    assert max(r[1] for r in got) == 4


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, c.collocations(docs).collect())) == brute([(r["lang"], r["text"]) for r in docs.collect()])


def test_a_phrase_begun_late_is_counted_for_one_round(spark):
    """Words rare in the first shards become frequent in later ones: longer phrases start late and run on past the last shard."""
    docs = spark.range(0, 400).selectExpr("id AS doc_id", "'en' AS lang", "concat('rare', id % 37, ' next', id % 37, ' last') AS text")
    counts, sizes = c.phrase_counts(docs, least=10, shards=9)
    got = {r["phrase"]: r["n"] for r in counts.collect()}
    plain = Counter()
    for i in range(400):
        ws = [f"rare{i % 37}", f"next{i % 37}", "last"]
        plain.update(" ".join(ws[a:b]) for a in range(3) for b in range(a + 1, 4))
    assert got == {p: n for p, n in plain.items() if n >= 10}
    assert [tuple(r) for r in sizes.collect()] == [("en", 1200)]


@pytest.mark.parametrize("limit", [1, 7, 30, 1000])
def test_parts_of_a_long_text_hold_each_phrase_once(limit):
    rng = random.Random(limit)
    text = "".join(rng.choice(["a", "bc", "d" * 25]) + rng.choice([" ", " ", " ", "\t", ". "]) for _ in range(300)).encode()

    def phrases(data, again):
        out = Counter()
        for k, piece in enumerate(re.split(rb"[.]", data)):
            ws = piece.split()
            out.update(tuple(ws[i : j + 1]) for j in range(again if k == 0 else 0, len(ws)) for i in range(max(j - 2, 0), j + 1))
        return out

    parts = Counter()
    for part, again in c.segments(text, limit, 3):
        parts += phrases(part, again)
    assert parts == phrases(text, 0)


def test_products_beyond_64_bits_stay_exact(spark):
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    counts = spark.createDataFrame(
        [(1, "en", "x", left), (1, "en", "y", right), (2, "en", "x y", a)], "size int, lang string, phrase string, n long"
    )
    sizes = spark.createDataFrame([("en", 10**12)], "lang string, n long")
    got = c.ranked(counts, sizes).collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, left, right, 10**12, 10**6 * a * a // (left * right))]


def test_no_documents_no_phrases(spark):
    assert c.collocations(docs_of(spark, cases()).limit(0)).collect() == []
    assert c.collocations(docs_of(spark, [(1, ("en", None))])).collect() == []


def test_shuffle_files_of_a_scan_are_let_go(spark):
    """Scans stage what they count, so their shuffles need not stay on disk together."""

    def shuffles() -> set[int]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = max(shuffles(), default=-1)
    docs = spark.createDataFrame([(i, "a b c d e f. a b c d", "en") for i in range(40)], "doc_id long, text string, lang string")
    counts, sizes = c.phrase_counts(docs, least=5, longest=4, shards=2, slot_bits=8)
    for _ in range(50):
        left = {s for s in shuffles() if s > before}
        if len(left) <= 2:  # those of the last scan may still be known
            break
        time.sleep(0.1)
    assert len(left) <= 2 and counts.count() > 0 and sizes.count() == 1
