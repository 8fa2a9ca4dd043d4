from __future__ import annotations

import math
import random
import re
from collections import Counter

import xxhash
from conftest import SF

from quaymetrics.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    ws = WORD.findall(text or "")
    windows = list(zip(ws, ws[1:], ws[2:], strict=False))
    often, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    failed = len(ws) < 50 or 100 * len(hit) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def cases():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["ab", "cde", "f", "É", "#x", "|"]) + ("\n" if rng.random() < 0.2 else "") for _ in range(rng.randrange(120)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one two"), (103, "a b c a b c"), (104, "same\nsame\n \nsame"), (105, "x " * 5000), (104, "same\nsame\n \nsame"), (None, "no id")]
    return rows


def test_plain_counts_equal_brute_force(spark, make_docs):
    rows = cases()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = q.quality_rules(make_docs(rows).repartition(3), labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(str((r["doc_id"], *[r[n] for n in names])) for r in out) == sorted(str((i, *plain_counts(t))) for i, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_good_texts_stay_and_bad_ones_go(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = q.quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").collect()
    good = [r["kept"] for r in out if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in out if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_without_labels_the_plain_rules_decide(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = q.quality_rules(make_docs(cases()), none).collect()
    assert all(r["kept"] != r["base_failed"] and r["score"] == 0 for r in out)
    assert q.quality_rules(make_docs([(1, "x")]).limit(0), none).collect() == []


def test_words_that_differ_only_before_their_endings_are_told_apart(spark, make_docs):
    """Half of the texts have the trusted ones' word endings on other stems; half of those with the trusted words are labelled."""
    rng = random.Random(7)
    endings = ["ing", "est", "ous", "ion", "ard"]
    rows = [(i, " ".join(("stem" if i < 40 else "$$$") + rng.choice(endings) for _ in range(200))) for i in range(80)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in q.quality_rules(make_docs(rows), labels).collect()}
    assert all(out[i]["score"] > 0 for i in range(40))
    assert all(out[i]["score"] < q.THRESHOLD for i in range(40, 80))


def test_scores_are_those_of_whole_words_and_their_pairs(spark, make_docs):
    rows = [r for r in cases() if r[0] not in (104, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")

    def buckets(text):
        raw = [xxhash.xxh64_intdigest(w.encode(), 42).to_bytes(8, "little") for w in WORD.findall(text or "")]
        one = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
        single = [xxhash.xxh64_intdigest(r, one) for r in raw]
        pairs = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(raw, raw[1:], strict=False)]
        return [h & (q.BUCKETS - 1) for h in single + pairs]

    corpus, target = Counter(), Counter()
    for i, t in rows:
        corpus.update(buckets(t))
        if i < 20:
            target.update(buckets(t))
    share = sum(target.values()) / sum(corpus.values())
    weight = {b: math.log(target[b] + q.K) - math.log(corpus[b] * share + q.K) for b in corpus}
    texts = dict(rows)
    for r in q.quality_rules(make_docs(rows), labels).collect():
        b = buckets(texts[r["doc_id"]])
        score = sum(weight[x] for x in b) / max(len(b), 1)
        assert abs(score - r["score"]) < 1e-5
        if abs(score - q.THRESHOLD) > 1e-5:
            assert r["kept"] == (not r["base_failed"] and score >= q.THRESHOLD)
