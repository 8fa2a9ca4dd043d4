"""SimHash near-dedup: fingerprints of word shingles, linked where at most `radius` of their 64 bits differ.

Fingerprints are compared in blocks. Two fingerprints within two bits agree on three of five bands of bits at least, so a
block holds the distinct fingerprints that share three bands (ten ways to choose them). Inside a block the bits stand in
planes, one vector of bits a position. The differences between one fingerprint and a stretch of the block are counted for
all its members at once, plane by plane, with carry-save counters; a stretch is left as soon as all have passed the radius.
A block gives one link a member at most, enough to connect what belongs together. A block of more than `most` members is
dealt out again by the bands of its remaining bits, which keeps every pair within the radius and bounds a block's size.

Defined cases: null and wordless texts have fingerprint zero and link like any other; fewer words than a shingle form one
shingle; a null doc_id sorts after all others and gets the component of its fingerprint; equal rows are rows of
their own; other columns don't matter. Only distinct fingerprints are compared, so groups of copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.common import ship, stage
from quaymetrics.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Members of a block that are compared without dealing it out again.
MOST = 4096
#: Bits by bands; radius + 3 bands, of which any two fingerprints within the radius share 3.
BITS = 64
#: Members compared at once.
STRETCH = 1024


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in more than half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: id, digest (of the text) and fp, the fingerprint as a signed long."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = [fingerprint(t, shingle) for t in part.column("text").to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), fp], ["id", "digest", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary"))
    return rows.mapInArrow(batches, "id long, digest long, fp long")


def bands(radius: int) -> list[int]:
    """Masks of the bits that the keys of the blocks hold: three of radius + 3 bands each."""
    edges = np.linspace(0, BITS, radius + 4).astype(int)
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, 3)]


def rest_bands(mask: int, radius: int) -> list[int]:
    """The bits that a mask leaves, in radius + 1 bands: any two fingerprints of its block agree on one of them."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(free, radius + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_in_block(fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a block the later members within the radius: bit-sliced, stretch by stretch."""
    m = len(fps)
    differing = np.bitwise_or.reduce(fps ^ fps[0])
    used = [b for b in range(BITS) if int(differing) >> b & 1]
    for lo in range(0, m, STRETCH):
        part = fps[lo : lo + STRETCH]
        planes = np.zeros((len(used), -(-len(part) // 64) * 64), np.uint8)
        for row, b in enumerate(used):
            planes[row, : len(part)] = (part >> np.uint64(b)).astype(np.uint8) & 1
        planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
        nobody = np.packbits(np.arange(planes.shape[1] * 64) >= len(part), bitorder="little").view(np.uint64)
        for i in range(min(lo + len(part), m)):
            q = int(fps[i])
            counters = [np.zeros(planes.shape[1], np.uint64) for _ in range(radius.bit_length())]
            over = nobody.copy()
            for row, b in enumerate(used):
                carry = ~planes[row] if q >> b & 1 else planes[row]
                for k, c in enumerate(counters):
                    counters[k], carry = c ^ carry, c & carry
                over |= carry
                if radius + 1 < 1 << len(counters):  # counters that hold radius + 1 have passed it
                    passed = ~np.uint64(0)
                    for k, c in enumerate(counters):
                        passed = passed & (c if (radius + 1) >> k & 1 else ~c)
                    over |= passed
                if (over == ~np.uint64(0)).all():
                    break
            else:
                near = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")) + lo
                if len(near := near[near > i]):
                    yield i, near


def block_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A link from each member to the first member of its group in the block."""
    parent = np.arange(len(fps))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, near in near_in_block(fps, radius):
        for j in near:
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(len(fps))])
    linked = roots != np.arange(len(fps))
    return fps[linked], fps[roots[linked]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """u, v: links that connect exactly what pairs of the distinct fingerprints (fp) within the radius connect."""
    masks = bands(radius)
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for k, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("b")).select("fp", "b.kind", "b.key")
    counted = keyed.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counted, ["kind", "key"])
    finer = F.array(*[
        F.when(F.col("kind") == k, F.array(*[
            F.struct(F.lit(i + 1).alias("part"), F.col("fp").bitwiseAND(_signed(r)).alias("rest"))
            for i, r in enumerate(rest_bands(m, radius))
        ]))
        for k, m in enumerate(masks)
    ])
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("rest")))
    parts = F.when(F.col("n") > most, F.get(finer, F.col("kind"))).otherwise(whole)
    blocks = met.select("kind", "key", "fp", F.explode(parts).alias("p")).select("kind", "key", "p.part", "p.rest", "fp")
    block = ["kind", "key", "part", "rest"]

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys in the sorted rows are blocks; the last one of a batch may go on in the next."""
        held: list[np.ndarray] | None = None
        for table in chain(tables, [None]):
            columns = [np.zeros(0, np.int64)] * 5 if table is None else [c.to_numpy().astype(np.int64) for c in table.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            n = len(columns[0])
            if not n:
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)) + 1
            edges = [0, *new.tolist()] + ([n] if table is None else [])
            held = None if table is None else [c[edges[-1] :] for c in columns]
            links = [block_links(columns[4][a:b].view(np.uint64), radius) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
            if links:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return blocks.repartition(*block).sortWithinPartitions(*block, "fp").mapInArrow(batches, "u long, v long")


def _rooted(marked: DataFrame, radius: int, most: int) -> DataFrame:
    """fp, least (id of its rows), root (the least fingerprint that it reaches)."""
    distinct = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-set")
    roots = components(fingerprint_links(distinct.select("fp"), radius, most)).withColumnRenamed("key", "fp")
    return stage(
        distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "fingerprint-roots"
    )


def near_dedup_report(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), digest (of the text)."""
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(marked, radius, most)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(named, "fp").select(F.col("id").alias("doc_id"), hexed, "component_id", "digest")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row of each component: the one with the least doc_id, of several that with the least digest of its text.

    Null doc_ids come last. Of rows equal in both one stays, so that rows repeated whole and components without any doc_id
    keep one row too. Rows are told apart by a number that they are staged with.
    """
    staged = stage(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("tag")), "near-documents")
    marked = stage(fingerprints(staged.select(F.col("tag").alias("doc_id"), "row.text"), shingle), "fingerprints")
    roots = _rooted(marked, radius, most).select("fp", "root")
    ids = staged.select("tag", F.col("row.doc_id").alias("doc_id"))
    members = marked.withColumnRenamed("id", "tag").join(roots, "fp").join(ids, "tag")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "tag"))["tag"]
    kept = members.groupBy("root").agg(first.alias("tag")).select("tag")
    return staged.join(kept, "tag", "left_semi").select("row.*")


ship(__name__)
