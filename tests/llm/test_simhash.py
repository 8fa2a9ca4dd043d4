from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from quaymetrics.llm.components import components
from quaymetrics.llm.simhash import bands, block_links, drop_near_duplicates, fingerprint_links, near_dedup_report


def plain_fingerprint(text):
    ws = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + 3]), 42) for k in range(max(len(ws) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys, radius):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = groups(set(prints), 2)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(group[f])) for (i, _), f in zip(rows, prints, strict=True)), key=str)


def cases():
    rng = random.Random(6)
    text = [rng.choice("abcdefghijk") + rng.choice("lmnop") for _ in range(400)]
    rows = []
    for i in range(40):
        copy = text[:]
        for _ in range(i % 4):
            copy[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.choice("abcdef") * 2 for _ in range(30))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (205, "two words"), (205, "two words"), (None, "one"), (None, "nobody else")]
    return rows


def test_equals_brute_force(spark, make_docs):
    rows = cases()
    got = near_dedup_report(make_docs(rows).repartition(3)).drop("digest")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_links_of_near_fingerprints_even_in_blocks_dealt_out_again(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(25):
            base ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(base)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    group = groups(prints, 2)
    want = sorted(sorted(k for k in prints if group[k] == root) for root in set(group.values()))
    for most in (4096, 2):
        links = fingerprint_links(spark.createDataFrame(signed, "fp long"), most=most)
        parent = {p: p for p in prints}

        def find(k, parent=parent):
            while parent[k] != k:
                k = parent[k]
            return k

        for u, v in links.collect():
            a, b = u % (1 << 64), v % (1 << 64)
            assert group[a] == group[b]
            parent[find(a)] = find(b)
        assert sorted(sorted(k for k in prints if find(k) == root) for root in {find(k) for k in prints}) == want


def test_any_two_near_fingerprints_share_a_block():
    rng = random.Random(1)
    for radius in (1, 2, 3):
        masks = bands(radius)
        for _ in range(300):
            differing = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(differing & m == 0 for m in masks)


def test_bit_sliced_distances_by_radius():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 700).astype(np.uint64) << np.uint64(7))
    for radius in (0, 1, 2, 3, 4):
        u, v = block_links(fps, radius)
        group = groups([int(f) for f in fps], radius)
        assert len(u) == len(fps) - len(set(group.values())) and all(group[int(a)] == group[int(b)] for a, b in zip(u, v, strict=True))


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = dict(map(tuple, components(spark.createDataFrame([*chain, *star, (5000, 5000), (7, 8)], "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_one_document_of_each_group_stays(spark, make_docs):
    rows = [r for r in cases() if r[0] is not None]
    docs = make_docs(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _, c in brute(rows) if i == c})  # rows repeated whole count once
    assert near_dedup_report(docs.limit(0)).collect() == []
