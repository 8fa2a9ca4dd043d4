"""Phrase collocations by dynamic itemset counting: which words stand together more often than they stand.

Texts are lower-cased (A-Z), split into pieces at `[.,;:!?]` and line ends, and those into words at blanks and tabs. A
phrase is a run of words within a piece; all counts are per language.

The corpus is dealt into `shards`, which are scanned one after the other, again and again. All lengths are counted in the
same scans: single words from the first shard on, and a longer phrase from the shard after which both phrases that are one
word shorter, its first and its last words, have been met `least` times. Each phrase is counted until its shard comes round
again, so that it has seen every shard once and its count is exact. Scans go on until no phrase is under way.

From which scan on a phrase is counted follows from a table of `slots` numbers a length: hashed phrases, each slot with the
scan at which the first of its phrases reached `least`. It is all that tasks are told, so what is broadcast does not grow
with the data. Two phrases in a slot make a longer one be counted that did not have to be: never too late, and never for
less than one round. Such phrases fall out by their counts.

A scan adds its counts, summed in each task before the shuffle, to the running ones, which are written to the shared folder;
phrases that have seen every shard and stayed below `least` are left out from then on.

Defined cases: a null text is empty; a null language counts as `und`; rows equal in all columns count one by one; texts and
pieces may be of any length, as they are counted in blocks; other columns don't matter; an empty table gives no phrase.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymetrics.llm.common import let_go, ship, stage, unstage

LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase goes if a longer candidate around it has so many of 100 of its occurrences.
INSIDE = 50
SCALE = 1_000_000
SHARDS = 2
SLOT_BITS = 22
#: Bytes of text that a task counts at a time.
BLOCK = 4 << 20
UNKNOWN = "und"

_NEVER = 255
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)], _KIND[list(_ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A language, a tab and words make one text, and size, slot and first scan one number: what is shuffled most is kept narrow.
_COUNTS = "phrase string, tag long, n long"


def segments(text: bytes, limit: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about `limit` bytes, and how many words at the start of each stand there again.

    Parts end where a piece does; in a longer piece between words, and the next part repeats as many as a phrase can reach.
    """
    at, repeated, again, room = 0, b"", 0, limit
    while len(text) - at > room:
        end = max(text.rfind(bytes([c]), at, at + room) for c in _ENDS)
        if end >= at:
            yield repeated + text[at:end], again
            at, repeated, again, room = end + 1, b"", 0, limit
            continue
        blank = max(text.rfind(bytes([c]), at, at + room) for c in _BLANKS)
        words = text[at:blank].split() if blank > at else []
        if len(words) < longest:  # words of enormous length
            room *= 2
            continue
        yield repeated + text[at:blank], again
        kept = words[-(longest - 1) :] if longest > 1 else []
        at, repeated, again, room = blank + 1, b"".join(w + b" " for w in kept), len(kept), limit
    yield repeated + text[at:], again


def blocks(langs: Sequence[str], texts: Sequence[bytes], limit: int, longest: int) -> Iterator[tuple[list[str], list[bytes], int]]:
    """Texts and their languages, as many at a time as `limit` bytes hold; how many words at the start are repeated."""
    held: tuple[list[str], list[bytes]] = ([], [])
    size = 0
    for lang, text in zip(langs, texts, strict=True):
        if len(text) > limit:
            for part, again in segments(text, limit, longest):
                yield [lang], [part], again
            continue
        if size + len(text) > limit:
            yield *held, 0
            held, size = ([], []), 0
        held[0].append(lang)
        held[1].append(text)
        size += len(text) + 1
    if held[0]:
        yield *held, 0


def count_block(
    langs: list[str], texts: list[bytes], again: int, scan: int, starts: list[np.ndarray], shards: int
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a block that scan `scan` is to count; `starts` has a table of slots for each length."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kinds = _KIND[data]
    inside = kinds == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # texts end with a line end: starts and ends alternate
    begins, ends = edges[0::2], edges[1::2]
    if not len(begins):
        return
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))]
    encoded = pa.Array.from_buffers(pa.binary(), len(begins), buffers).dictionary_encode()
    words, codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    joins = np.diff(np.cumsum(kinds == 2)[begins], prepend=-1) == 0  # the word follows the one before it in its piece
    names, of_text = np.unique(np.array(langs, object).astype(str), return_inverse=True)
    lang = of_text[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, "right")]
    del data, kinds, inside, edges, begins, ends, offsets, buffers
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)[codes]
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
    named = pa.array([x.encode() for x in names], pa.binary())
    n_words, shift = len(words), np.uint64(64 - (len(starts[0]).bit_length() - 1) if starts else 0)
    fresh = np.arange(len(codes)) >= again
    whole = np.ones(len(codes), bool)  # a phrase of this length ends here
    start = np.zeros(len(codes), np.int64)
    mixed = (hashes ^ seeds[lang]) * _STEP
    ids = lang * n_words + codes
    for size in range(1, len(starts) + 2):
        slot = ((mixed * _SPREAD) >> shift).astype(np.int64) if size <= len(starts) else np.zeros(len(codes), np.int64)
        chosen = np.flatnonzero(whole & fresh & (start <= scan) & (scan < start + shards))
        if len(chosen):
            _, first, n = np.unique(ids[chosen], return_index=True, return_counts=True)
            at = chosen[first]
            parts = [words.take(pa.array(codes[at - k])) for k in range(size - 1, -1, -1)]
            phrase = pc.binary_join_element_wise(named.take(pa.array(lang[at])), parts[0], b"\t")
            phrase = pc.binary_join_element_wise(phrase, *parts[1:], b" ")
            tag = size << 48 | slot[at] << 8 | start[at]
            columns = [phrase.cast(pa.string()), pa.array(tag), pa.array(n)]
            yield pa.record_batch(columns, [c.split()[0] for c in _COUNTS.split(", ")])
        if size > len(starts) or starts[size - 1].min() == _NEVER:
            return
        begun = starts[size - 1][slot].astype(np.int64)  # the scan from which longer phrases may hold this one
        begun[~whole] = _NEVER
        if ids.max() >= (1 << 62) // max(n_words, 1):
            ids = np.unique(ids, return_inverse=True)[1]
        following = np.zeros(len(codes), bool)
        following[1:] = joins[1:] & whole[1:] & whole[:-1]
        start = np.maximum(begun, np.concatenate([[_NEVER], begun[:-1]]))
        whole = following & (start < _NEVER)
        mixed = np.concatenate([mixed[:1], mixed[:-1]]) * _STEP + hashes
        ids = np.concatenate([ids[:1], ids[:-1]]) * n_words + codes


def _scanning(scan: int, starts, shards: int, longest: int, block: int):
    def scanned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1000):
                rows = part.slice(at, 1000)
                texts = rows.column("text").cast(pa.binary()).to_pylist()
                for some in blocks(rows.column("lang").to_pylist(), texts, block, longest):
                    yield from count_block(*some, scan, starts.value, shards)

    return scanned


def _began(totals: DataFrame, least: int, tables: list[np.ndarray], scan: int) -> None:
    """Enter into the tables the slots of phrases that have reached `least`. At most a row for 64 slots reaches the driver."""
    slot = F.expr("shiftright(tag, 8) & 1099511627775L")
    reached = totals.where(F.col("n") >= least).select(_size().alias("size"), slot.alias("slot")).where(F.col("size") <= len(tables))
    bit = F.expr("shiftleft(1L, cast(slot % 64 AS int))")
    words = reached.groupBy("size", F.expr("slot div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    for size, rows in words.toPandas().groupby("size"):
        bits = np.zeros(len(tables[size - 1]) // 64, np.int64)
        bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        met = np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)
        tables[size - 1][met & (tables[size - 1] == _NEVER)] = scan + 1


def _size() -> Column:
    return F.shiftright("tag", 48).cast("int")


def _parted(totals: DataFrame) -> DataFrame:
    """size, lang, phrase, n. Words hold no tab."""
    words = F.substring_index("phrase", "\t", -1)
    lang = F.expr("left(phrase, length(phrase) - length(substring_index(phrase, '\t', -1)) - 1)")
    return totals.select(_size().alias("size"), lang.alias("lang"), words.alias("phrase"), "n")


def phrase_counts(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slot_bits: int = SLOT_BITS, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """size, lang, phrase, n of all phrases of up to `longest` words met `least` times, and lang, n of all its words."""
    if longest < 1 or shards < 1 or longest * shards >= _NEVER or not 6 <= slot_bits <= 40:
        raise ValueError("longest and shards must be positive, their product below 255, and slot_bits from 6 to 40")
    ship(__name__)
    context = docs.sparkSession.sparkContext
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard")
    lang = F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")
    dealt = stage(docs.where(F.length("text") > 0).select(lang, "text", shard), "collocation-shards", by="shard")
    tables = [np.full(1 << slot_bits, _NEVER, np.uint8) for _ in range(longest - 1)]
    totals, sizes, scan = None, None, 0
    while scan < shards or any(np.any((t < _NEVER) & (t.astype(int) + shards > scan)) for t in tables):
        known = context.broadcast(tables)
        rows = dealt.where(F.col("shard") == scan % shards).select("lang", "text")
        met = rows.mapInArrow(_scanning(scan, known, shards, longest, block), _COUNTS)
        if totals is not None:
            met = met.unionByName(totals.where((F.col("n") >= least) | (F.expr("tag & 255L") + shards > scan)))
        added = met.groupBy("phrase").agg(F.max("tag").alias("tag"), F.sum("n").alias("n"))
        before, totals = totals, stage(added, f"collocation-counts-{scan}")
        del met, added
        if before is not None:
            unstage(before)
        known.destroy()
        if scan == shards - 1:
            sizes = stage(_parted(totals.where(_size() == 1)).groupBy("lang").agg(F.sum("n").alias("n")), "collocation-sizes")
        _began(totals, least, tables, scan)
        let_go(docs.sparkSession)
        scan += 1
    unstage(dealt)
    return _parted(totals.where(F.col("n") >= least)), sizes


def _words_of(first: Column, last: Column) -> Column:
    """Words number first to last of the array `words`, joined again."""
    return F.array_join(F.slice("words", first, last - first + 1), " ")


def _runs(length: int) -> Column:
    """All runs of `length` of the array `words`."""
    firsts = F.sequence(F.lit(1), F.size("words") - (length - 1))
    return F.transform(firsts, lambda first: _words_of(first, first + (length - 1)))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, **how: int
) -> DataFrame:
    """lang, rank, phrase, a (its occurrences), l and r (of the two sides of the weakest cut), n (words), score.

    A phrase of two words or more is a candidate if it occurs `least` times. A cut after k words gives
    floor(SCALE * a * a / (l * r)); the lowest one counts, and of equal ones that with the smallest k. Candidates go that
    lie within a longer one which has `inside` of 100 of their occurrences. Of each language `top` phrases are returned.
    """
    return ranked(*phrase_counts(docs, least, longest, **how), longest, top, inside)


def ranked(counts: DataFrame, sizes: DataFrame, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """collocations() from the tables of phrase_counts()."""
    counts = counts.withColumn("words", F.split("phrase", " "))
    candidates = counts.where("size > 1")
    cuts = candidates.select("lang", "phrase", "size", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words_of(F.lit(1), F.col("k")).alias("left"), _words_of(F.col("k") + 1, F.col("size")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
        cuts = cuts.join(part, ["lang", side])
    a, l, r = (F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r"))
    score = F.call_function("div", (a * a).cast("decimal(30,0)") * F.lit(SCALE).cast("decimal(7,0)"), l * r)
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    if longest > 2:
        # of a longer candidate, the shorter ones in it
        within = candidates.where("size > 2").select("lang", "size", "words", "n")
        runs = [F.when(F.col("size") > m, _runs(m)).otherwise(F.array().cast("array<string>")) for m in range(2, longest)]
        parts = within.select("lang", "n", F.explode(F.concat(*runs)).alias("phrase"))
        longer = parts.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        scored = scored.join(longer, ["lang", "phrase"], "left")
        scored = scored.where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")
    place = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
