from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from quaymetrics.llm.mixing import apply_mix, mix_report


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Round after round: what goes beyond a bound is shared again among the others by weight."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, open_ = {}, set(order)
    total = share * sum(sizes.values())
    while open_:
        level = (total - sum(full.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in open_}
        full |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return full


def cases():
    rng = random.Random(12)
    rows = []
    for source, n in ((None, 30), ("a", 200), ("b", 40), ("é", 60), ("z", 10), ("empty", 3), ("tiny", 1)):
        for _ in range(n):
            size = 0 if source == "empty" else int(math.exp(rng.uniform(0, 5)))
            rows.append((len(rows), " \t".join("w" for _ in range(size)), source))
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, "word " * 3000, "a"), (9003, "x y", "a"), (9003, "x y", "a"), (None, "x y z", "a")]
    rows += [(10_000 + i, "same size of copies", "a") for i in range(500)]
    return rows


@pytest.mark.parametrize("options", [{}, {"share": 0.4}, {"share": 2.0}, {"weights": (1, 5), "share": 1.0, "cap": 3}])
def test_targets_are_met_within_the_bounds(spark, make_docs, options):
    rows = cases()
    out = mix_report(make_docs(rows).repartition(4), **options).collect()
    assert len(out) == len(rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sums = defaultdict(int)
    for i, t, s in rows:
        sums[s] += size[i]
    targets, taken = plain_targets(sums, **options), defaultdict(int)
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[source[r["doc_id"]]]
        assert math.isclose(r["target"], targets[source[r["doc_id"]]], rel_tol=1e-9, abs_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= options.get("cap", 2)
        taken[source[r["doc_id"]]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(2, 0.02 * t), s


def test_rates_are_exponentially_tilted(spark, make_docs):
    """Of two sizes of one source the copies follow min(2, exp(lambda * size)) with one lambda for both."""
    rows = [(i, "w " * 10, "s") for i in range(1000)] + [(1000 + i, "w " * 30, "s") for i in range(1000)]
    got = defaultdict(int)
    for r in mix_report(make_docs(rows), weights=(1,), share=0.5).collect():
        got[r["size"]] += r["copies"]
    small, large = got[10] / 1000, got[30] / 1000
    assert math.isclose(math.log(large) / math.log(small), 3, rel_tol=0.02)


def test_reruns_agree_and_copies_come_out(spark, make_docs):
    rows = cases()
    one = sorted(map(str, mix_report(make_docs(rows).repartition(5)).collect()))
    two = sorted(map(str, mix_report(make_docs(rows[::-1]).repartition(2)).collect()))
    assert one == two
    unique = [r for r in rows if r[0] not in (9003,)]
    docs = make_docs(unique)
    mixed = apply_mix(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    copies = {r["doc_id"]: r["copies"] for r in mix_report(docs).collect()}
    counted = defaultdict(list)
    for r in mixed.collect():
        counted[r["doc_id"]].append(r["copy"])
    assert {i: sorted(c) for i, c in counted.items()} == {i: list(range(1, n + 1)) for i, n in copies.items() if n}


def test_empty_table_and_nothing_to_take(spark, make_docs):
    docs = make_docs([(1, None, "a"), (2, "", None)])
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mix_report(docs).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mix_report(docs.limit(0)).collect() == [] and apply_mix(docs.limit(0)).collect() == []
