from __future__ import annotations

import hashlib
import random
import re

from conftest import rows as values

from quaymetrics.llm.decontaminate import contamination, cut_contaminated, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    grams = {}
    for item, text in items:
        ws = WORD.findall(lowered(text))
        for k in range(max(len(ws) - 9, 1) if ws else 0):
            grams.setdefault(tuple(ws[k : k + 10]), set()).add(item)
    out = []
    for i, text in docs:
        ws = WORD.findall(lowered(text))
        hit, named = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(ws) - n + 1):
                if found := grams.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    named |= {str(x) for x in found if x is not None}
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((i, len(ws), len(hit), len(named), digest, bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice(["Alpha", "beta", "Ünï", "x1", "the", "of", "zeta9"])
    items = [(k, " ".join(word() for _ in range(rng.choice([14, 12, 10])))) for k in range(20)]
    items += [(50, "one two three"), (51, "rare"), (52, None), (53, "?!"), (54, items[0][1]), (54, items[0][1]), (None, "very special words")]
    docs = []
    for k in range(80):
        words = [word() for _ in range(rng.randrange(60))]
        if k % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = items[k % 20][1].upper().split()
        docs.append((k, "-".join(words) if k % 2 else ", ".join(words)))
    docs += [(100, None), (101, ""), (102, "RARE"), (103, "one  two;three one two"), (104, "rarely"), (105, "very special words"), (102, "RARE"), (None, "a rare one")]
    return docs, items


def test_equals_brute_force_whatever_the_set_lets_through(spark, make_docs):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for cell_bits in (20, 2, 0):  # with four cells and with one, nearly all windows are false hits
        got = contamination(make_docs(docs).repartition(3), benchmark, cell_bits=cell_bits)
        assert sorted(values(got), key=str) == brute(docs, items)


def test_no_word_arrays_are_shuffled_also_without_broadcasts(spark, make_docs):
    docs, items = cases()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = contamination(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(values(got), key=str) == brute(docs, items)
        plan = got._jdf.queryExecution().optimizedPlan()
        joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
        assert len(joins) >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # what goes into the exchange of the windows: key, place, hash and own words
    shuffled = [re.sub(r"#\d+L?", "", line) for line in plan.toString().splitlines() if "AS own" in line]
    assert len(shuffled) == 1 and re.search(r"Project \[id, digest, at, found, array_join\(slice\(words.*AS own\]", shuffled[0]), shuffled


def test_dropping_and_cutting(spark, make_docs):
    docs, items = cases()
    made, benchmark = make_docs(docs), spark.createDataFrame(items, "item_id long, text string")
    dirty = {str(r[0]) for r in brute(docs, items) if r[-1]}
    kept = drop_contaminated(made, benchmark)
    assert kept.columns == made.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in dirty)
    cut = {r["doc_id"]: r["text"] for r in cut_contaminated(made, benchmark).collect()}
    assert cut[102] == "" and cut[103] == " one two" and cut[104] == "rarely" and cut[100] is None and cut[None] == "a  one"


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs([(1, "a b"), (2, None)])
    assert sorted((r["doc_id"], r["n_words"], r["contaminated"]) for r in contamination(docs, none).collect()) == [(1, 2, False), (2, 0, False)]
    assert contamination(docs.limit(0), none).collect() == []
