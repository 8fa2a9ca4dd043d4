from __future__ import annotations

import math
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quaymetrics.llm import lm_score
from quaymetrics.llm.quality_classifier import remainder
from quaymetrics.llm.queries import VOCABULARY

SPACE = b" \t\n\r\x0b\x0c"


def all_ways(word: bytes, pieces: dict[bytes, float]) -> float:
    """The sum over every segmentation, one by one."""
    if not word:
        return 1.0
    return sum(p * all_ways(word[len(piece) :], pieces) for piece, p in pieces.items() if word.startswith(piece))


@pytest.mark.parametrize("many", [1, 20])
def test_forward_recursion_equals_the_sum_over_segmentations(many):
    start = lm_score.START
    pieces = {start: 0.1, start + b"a": 0.05, b"a": 0.1, b"ab": 0.2, b"b": 0.05, b"abc": 0.1, b"c": 0.1, b"abababababab": 0.1, b"abcabcabcabcabcabcabc": 0.2}
    lattice = lm_score.Lattice(list(pieces), np.log(list(pieces.values())))
    words = [b"", b"a", b"ab", b"abc", b"abababababab", b"abcabcabcabcabcabcabc", b"abababababababc"]
    got = lattice.log10([w for w in words for _ in range(many)])[::many]
    for w, g in zip(words, got, strict=True):
        assert math.isclose(g, math.log10(all_ways(start + w, pieces)), rel_tol=1e-9)
    assert lattice.log10([b"zz"])[0] == -math.inf


def test_the_public_vocabulary_gives_every_word_a_probability():
    pieces = lm_score.vocabulary(VOCABULARY)
    prior = lm_score.prior_counts(VOCABULARY)
    assert len(pieces) == 32_000 and math.isclose(prior.sum(), lm_score.PRIOR)
    with np.errstate(divide="ignore"):
        lattice = lm_score.Lattice(pieces, np.log(prior[:-1] / prior.sum()))
    words = [b"the", "日本".encode(), b"\xff\x00", "▁".encode(), b"x" * 3000]
    scores = lattice.log10(words)
    assert np.isfinite(scores).all() and (scores < 0).all()
    pairs = lattice.log10(["ñandú".encode()] * 9)
    assert np.allclose(pairs, lattice.log10(["ñandú".encode()]))


def test_stretches_of_a_long_word_change_nothing(monkeypatch):
    prior = lm_score.prior_counts(VOCABULARY)
    with np.errstate(divide="ignore"):
        lattice = lm_score.Lattice(lm_score.vocabulary(VOCABULARY), np.log(prior[:-1] / prior.sum()))
    words = [b"internationalisation" * k for k in (1, 7, 30)] + ["日本語の文章".encode() * 9, b"x" * 500, b"ab" * 250]
    whole = lattice.log10(words)
    assert np.allclose(whole, np.concatenate([lattice.log10([w] * 9)[:1] for w in words]), rtol=1e-12)  # by columns
    for piece in (1, 7, 64):
        monkeypatch.setattr(lm_score, "PIECE", piece)
        assert np.allclose(lattice.log10(words), whole, rtol=1e-12)


def test_a_word_of_megabytes_needs_little_memory():
    script = f"""
import resource, sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
import numpy as np
from quaymetrics.llm import lm_score
from quaymetrics.llm.queries import VOCABULARY
prior = lm_score.prior_counts(VOCABULARY)
with np.errstate(divide="ignore"):
    lattice = lm_score.Lattice(lm_score.vocabulary(VOCABULARY), np.log(prior[:-1] / prior.sum()))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert np.isfinite(lattice.log10([bytes(range(65, 91)) * 80_000])).all()
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True).stdout
    assert int(grown) < 200_000  # KB, for 2 MB of text


def brute_base(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    ends = held.count(False)
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for (i, _), ws, h in zip(rows, words, held, strict=True):
        each = [counts[w] for w in ws] + [ends]
        score = sum(math.log10((c + 1) / (total + distinct + 1)) for c in each)
        out.append((i, h, len(each), sum(c > 0 for c in each), total, score))
    return out


def same(got, want):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)


def scored(docs, **options):
    return lm_score.lm_scores(docs, remainder("doc_id", 7) == 2, VOCABULARY, **options)


def test_base_equals_brute_force_however_short_the_list_is(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = None
    for head in (100_000, 30, 0):
        out = scored(docs, head=head).collect()
        same(out, brute_base(rows))
        scores = {r["doc_id"]: r["score"] for r in out}
        first = first or scores
        assert all(math.isclose(scores[i], s, rel_tol=1e-9) for i, s in first.items())


def test_scores_are_sums_over_words_and_an_end(spark, make_docs):
    out = {r["doc_id"]: r["score"] for r in scored(make_docs([(1, "one two"), (3, "one"), (4, "two"), (5, ""), (6, "two  ONE\n")])).collect()}
    assert math.isclose(out[1] - out[5], (out[3] - out[5]) + (out[4] - out[5]), rel_tol=1e-9) and math.isclose(out[1], out[6], rel_tol=1e-9)


def test_edge_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "x" * 20_000), (5, "w " * 20_000), (9, "ünï"), (10, "b")]
    same(scored(make_docs(rows)).collect(), brute_base(rows))
    assert scored(make_docs([(1, "x")]).limit(0)).collect() == []
    alone = scored(make_docs([(i, "x y") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert alone and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)


def test_held_out_texts_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    held = remainder("doc_id", 7) == 2
    changed = docs.withColumn("text", F.when(held, F.lit("other words")).otherwise(F.col("text")))
    before = {r["doc_id"]: r["score"] for r in scored(docs).collect() if not r["held_out"]}
    after = {r["doc_id"]: r["score"] for r in scored(changed).collect() if not r["held_out"]}
    assert before.keys() == after.keys() and all(math.isclose(before[i], after[i], rel_tol=1e-9) for i in before)
