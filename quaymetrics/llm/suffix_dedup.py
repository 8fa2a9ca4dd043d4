"""Suffix-array dedup: bytes inside a repeated string of `WINDOW` bytes go, except at the string's first occurrence.

The suffix arrays are sparse. Every window of 100 bytes picks one of its positions by content alone: the leftmost of its
16-byte grams with the least hash. So equal windows pick the same place, and suffixes that start at picked places (one in
about 43) find every repeat. A suffix stands in order of the hash of its first gram, then of the hash of its whole
context: all bytes of the windows that picked it.

1. Each batch of documents becomes sorted runs of suffixes, one run for each range of gram hashes ("bucket"). A context
   met earlier in the batch is a repeat already: it is marked and not sent on, so a frequent passage travels once a batch.
2. A shard takes the runs of its buckets one by one into a family of levels: a new run is merge-scanned against every
   level for equal contexts, the later one being marked, and levels of like size merge, so that sizes grow geometrically.
3. Different contexts may still share windows, at the ends of a repeated passage. Contexts that share the gram and the
   42 bytes before or after it are compared window by window, with the bytes fetched from the documents. Grams with
   many contexts in one batch are compared by hashes of single windows, spread over all shards.
4. Marks meet the texts by row and are cut out.

Contexts are compared by 128 bits of hash (gram and context), windows by XXH3 with 128 bits. Suffixes are ordered by these
hashes, not by their bytes: equal contexts stand together, which is all that the merge scan asks for.

Every row is a document of its own, told apart by a number that it is staged with; doc_id says which one is earlier.

Defined cases: a null text is empty and stays; texts under 100 bytes have no window; a null doc_id counts as the largest
id there is; of rows with one doc_id, or none, the one staged first is the earlier document, so that a row repeated whole
is cut and a row without repeats never is; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.common import ship, stage, unstage

WINDOW = 100
GRAM = 16
#: Of the 84 bytes that a window has beside its gram, one side has half at least.
SIDE = (WINDOW - GRAM) // 2
#: Contexts of one gram in one batch from which the gram's windows are spread one by one.
CROWDED = 32
#: Windows that are compared in memory at once, and bytes of text that are hashed at once.
AT_ONCE = 250_000
CHUNK = 1 << 18
LAST_ID = (1 << 63) - 1

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Columns of a suffix: gram hash, context hash, hashes of the sides (0: not inside the context), doc_id, row, place of the
#: context's first byte, and its windows less one. CROWD in the last column tells that the gram is crowded.
SUFFIX = np.dtype([("key", "u8"), ("cls", "u8"), ("left", "u4"), ("right", "u4"), ("doc", "i8"), ("row", "i8"), ("lo", "i4"), ("more", "u1")])
CROWD = 255
#: A single window: its 128-bit hash, doc_id, row and start.
SINGLE = np.dtype([("w1", "u8"), ("w2", "u8"), ("doc", "i8"), ("row", "i8"), ("lo", "i4")])
#: What says which of two places is earlier.
PLACE = ("doc", "row", "lo")
#: A candidate in a document: gram hash, context, whether its gram is crowded.
CANDIDATE = np.dtype([("key", "u8"), ("lo", "i4"), ("more", "u1"), ("crowded", "u1")])
SPAN = np.dtype([("start", "i4"), ("end", "i4")])
RUN, SPANS, CANDIDATES, SINGLES, CONTEXTS = range(5)
ROWS = "kind int, bucket int, id long, blob binary"


def _pack(table: np.ndarray) -> bytes:
    """Columns one after the other, each byte place by itself: zeros and near values lie together for the compressor."""
    return b"".join(np.ascontiguousarray(table[c]).view(np.uint8).reshape(len(table), -1).T.tobytes() for c in table.dtype.names)


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    n = len(blob) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for c in kind.names:
        width = kind[c].itemsize
        out[c] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T).view(kind[c]).ravel()
        at += n * width
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x ^= x >> np.uint64(32)
    x = (x ^ b) * _B
    x ^= x >> np.uint64(29)
    x *= _C
    return x ^ (x >> np.uint64(32))


def _grams(data: bytes) -> np.ndarray:
    """The hash of the 16 bytes at each place."""
    n = len(data) - GRAM + 1
    words = np.ndarray((n + 8,), "<u8", data, strides=(1,))
    return _mix(words[:n], words[8 : n + 8])


def _picked(hashes: np.ndarray) -> np.ndarray:
    """For each window the place of its leftmost least gram hash."""
    width, least, place, reach = 1, hashes, np.arange(len(hashes)), WINDOW - GRAM + 1
    while width < reach:
        step = min(width, reach - width)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.minimum(least[step:], least[:-step])
        width += step
    return place


def suffixes(data: bytes, starts: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the documents that stand one after the other in data, each WINDOW bytes long at least, and the place
    of each one's context in data."""
    hashes = _grams(data)
    place = _picked(hashes)
    ends = np.append(starts[1:], len(data))
    inside = np.ones(len(place), bool)
    for end in ends[:-1]:
        inside[end - WINDOW + 1 : end] = False
    windows = np.flatnonzero(inside)
    place = place[windows]
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    gram, lo = place[new], windows[new]
    hi = windows[np.append(new[1:], len(place)) - 1]
    at = np.searchsorted(starts, gram, "right") - 1
    out = np.empty(len(gram), SUFFIX)
    out["key"], out["doc"], out["row"], out["lo"], out["more"] = hashes[gram], docs[at], rows[at], lo - starts[at], hi - lo
    cls, last = (hi - lo).astype(np.uint64), hi + WINDOW - GRAM
    for step in range(0, 2 * WINDOW - GRAM, GRAM):
        cls = _mix(cls, hashes[np.minimum(lo + step, last)])
    out["cls"] = cls
    # three grams cover the bytes of a side
    for name, offsets, whole in (
        ("left", (-SIDE, GRAM - SIDE, -GRAM), gram - SIDE >= lo),
        ("right", (GRAM, 2 * GRAM, SIDE), gram + GRAM + SIDE <= hi + WINDOW),
    ):
        side = np.zeros(len(gram), np.uint64)
        for o in offsets:
            side = _mix(side, hashes[np.clip(gram + o, 0, len(hashes) - 1)])
        out[name] = np.where(whole, side.astype(np.uint32) | np.uint32(1), np.uint32(0))
    return out, lo


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    return np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)) if len(columns[0]) else np.zeros(0, bool)


def _first_and_later(table: np.ndarray, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first of each group of rows equal in `by`, and of those that stand at a later place."""
    order = np.lexsort([table[c] for c in (*PLACE[::-1], *by[::-1])])
    head = _heads(*[table[c][order] for c in by])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = np.zeros(len(order), bool)
    for c in PLACE:
        later |= table[c][order] != table[c][first]
    return order[head], order[later]


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans in order, those that overlap or touch as one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1]) if len(start) else np.zeros(0, bool)
    out = np.empty(int(new.sum()), SPAN)
    out["start"] = start[new]
    out["end"] = reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1] if len(start) else 0
    return out


def _by_row(row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(row, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(row) else ():
        yield int(row[same[0]]), same


class _Out:
    """Rows of ROWS, given out in batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def spans(self, row: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> None:
        for id_, rows in _by_row(row):
            self.rows.append((SPANS, id_ % buckets, id_, _pack(merged(start[rows], end[rows]))))

    def dealt(self, kind: int, by: np.ndarray, table: np.ndarray, buckets: int) -> None:
        bucket = (by >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            self.rows.append((kind, int(bucket[rows[0]]), None, _pack(table[rows])))

    def batches(self) -> Iterator[pa.RecordBatch]:
        size = 0
        start = 0
        for i, row in enumerate(self.rows):
            size += len(row[3])
            if size > 1 << 23 or i - start > 5000 or i == len(self.rows) - 1:
                part, start, size = self.rows[start : i + 1], i + 1, 0
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "id", "blob"])
        self.rows = []


def _singles(texts: Iterable[tuple[int, int, int, bytes]]) -> np.ndarray:
    """Every window of contexts (doc_id, row, place, bytes) with its hash."""
    digest, hashes, docs, rows, los = xxhash.xxh3_128_digest, [], [], [], []
    for doc, row, lo, context in texts:
        n = len(context) - WINDOW + 1
        hashes += [digest(context[i : i + WINDOW]) for i in range(n)]
        docs.append(np.full(n, doc, np.int64))
        rows.append(np.full(n, row, np.int64))
        los.append(np.arange(lo, lo + n))
    out = np.empty(len(hashes), SINGLE)
    if hashes:
        both = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
        out["w1"], out["w2"], out["doc"], out["row"] = both[:, 0], both[:, 1], np.concatenate(docs), np.concatenate(rows)
        out["lo"] = np.concatenate(los)
    return out


def _firsts_of_singles(singles: np.ndarray, out: _Out, buckets: int) -> np.ndarray:
    """Marks the windows that start later than an equal one; returns the others."""
    first, later = _first_and_later(singles, ("w1", "w2"))
    gone = singles[later]
    out.spans(gone["row"], gone["lo"], gone["lo"] + WINDOW, buckets)
    return singles[first]


def _batch_of_suffixes(ids: np.ndarray, tags: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a batch and the row of texts that each is from."""
    found, rows = [], []
    held, size = [], 0
    long_enough = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
    for k, i in enumerate(long_enough):
        held.append(i)
        size += len(texts[i])
        if size >= CHUNK or k == len(long_enough) - 1:
            starts = np.concatenate(([0], np.cumsum([len(texts[j]) for j in held])[:-1]))
            part, at = suffixes(b"".join([texts[j] for j in held]), starts, ids[held], tags[held])
            found.append(part)
            rows.append(np.array(held)[np.searchsorted(starts, at, "right") - 1])
            held, size = [], 0
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.empty(0, SUFFIX), np.empty(0, int))


def _runs(buckets: int):
    """Step 1: documents (id, row, text) to runs, marks and single windows of crowded grams."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("id").to_numpy()
            texts = part.column("text").to_pylist()
            out = _Out()
            found, rows = _batch_of_suffixes(ids, part.column("row").to_numpy(), texts)
            first, later = _first_and_later(found, ("key", "cls"))
            gone = found[later]
            out.spans(gone["row"], gone["lo"], gone["lo"] + gone["more"] + WINDOW, buckets)
            run, rows = found[first], rows[first]
            head = np.flatnonzero(_heads(run["key"]))
            crowd = np.repeat(n := np.diff(np.append(head, len(run))), n) > CROWDED
            if crowd.any():
                many = run[crowd]
                spread = _singles((int(s["doc"]), int(s["row"]), int(s["lo"]), texts[r][s["lo"] : int(s["lo"]) + int(s["more"]) + WINDOW]) for s, r in zip(many, rows[crowd], strict=True))
                spread = _firsts_of_singles(spread, out, buckets)
                out.dealt(SINGLES, spread["w1"], spread, buckets)
                flags = many[_heads(many["key"])]
                flags["cls"], flags["left"], flags["right"], flags["more"] = 0, 0, 0, CROWD
                run = np.concatenate((run[~crowd], flags))
            out.dealt(RUN, run["key"], run, buckets)
            yield from out.batches()

    return batches


class Levels:
    """A family of sorted suffix arrays whose sizes grow geometrically. No context is in two of them."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []
        self.later: list[np.ndarray] = []
        self.crowded: set[int] = set()

    @staticmethod
    def _rank(run: np.ndarray) -> np.ndarray:
        """An order by gram, then context, in one number; equal numbers need a second look."""
        low = np.uint64((1 << 20) - 1)
        return (run["key"] & ~low) | (run["cls"] & low)

    def add(self, run: np.ndarray) -> None:
        flags = run["more"] == CROWD
        self.crowded.update(run["key"][flags].tolist())
        run = run[~flags]
        run = run[np.argsort(self._rank(run), kind="stable")]
        for level in self.levels:
            run = self._scanned(run, level)
        self.levels.append(run)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) >= len(self.levels[-2]):
            both = np.concatenate((self.levels.pop(-2), self.levels.pop()))
            self.levels.append(both[np.argsort(self._rank(both), kind="stable")])

    def _scanned(self, run: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Marks the later one of each context that is in both; the level keeps the earlier one, the run loses it."""
        wanted, there = self._rank(run), self._rank(level)
        at = np.searchsorted(there, wanted)
        known = np.zeros(len(run), bool)
        active = np.arange(len(run))
        while len(active):
            inside = at[active] < len(level)
            active = active[inside]
            active = active[there[at[active]] == wanted[active]]
            same = (level["key"][at[active]] == run["key"][active]) & (level["cls"][at[active]] == run["cls"][active])
            new, old = active[same], at[active[same]]
            known[new] = True
            earlier, tie = np.zeros(len(new), bool), np.ones(len(new), bool)
            for c in PLACE:
                earlier |= tie & (run[c][new] < level[c][old])
                tie &= run[c][new] == level[c][old]
            self.later += [level[old[earlier]], run[new[~earlier & ~tie]]]
            level[old[earlier]] = run[new[earlier]]
            active = active[~same]
            at[active] += 1
        return run[~known]

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts that may share windows with others, and whether their gram is crowded."""
        every = np.concatenate(self.levels) if self.levels else np.empty(0, SUFFIX)
        crowded = np.isin(every["key"], np.array(sorted(self.crowded), np.uint64))
        wanted = crowded.copy()
        for side in ("left", "right"):
            order = np.lexsort((every[side], every["key"]))
            head = _heads(every["key"][order], every[side][order])
            alone = head & np.append(head[1:], True)
            wanted[order[~alone & (every[side][order] != 0)]] = True
        return every[wanted], crowded[wanted]


def _shards(buckets: int):
    """Step 2: the runs of a shard's buckets to marks and candidates. Other rows pass."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, out = Levels(), _Out()
        for part in parts:
            kinds = part.column("kind").to_numpy()
            if (kinds != RUN).any():
                yield part.filter(pa.array(kinds != RUN))
            for blob in part.column("blob").filter(pa.array(kinds == RUN)):
                levels.add(_unpack(blob.as_py(), SUFFIX))
        if levels.later:
            gone = np.concatenate(levels.later)
            out.spans(gone["row"], gone["lo"], gone["lo"] + gone["more"] + WINDOW, buckets)
        wanted, crowded = levels.candidates()
        table = np.empty(len(wanted), CANDIDATE)
        table["key"], table["lo"], table["more"], table["crowded"] = wanted["key"], wanted["lo"], wanted["more"], crowded
        for id_, rows in _by_row(wanted["row"]):
            out.rows.append((CANDIDATES, None, id_, _pack(table[rows])))
        yield from out.batches()

    return batches


CONTEXT = np.dtype([("key", "u8"), ("doc", "i8"), ("row", "i8"), ("lo", "i4"), ("more", "u1"), ("bytes", "u1", (2 * WINDOW - GRAM,))])


def _contexts(buckets: int):
    """Step 3, at the documents (id, row, text, blobs): the bytes of the candidates, or their windows where crowded."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out, singles, tables = _Out(), [], []
            for id_, tag, text, blobs in zip(*[part.column(c).to_pylist() for c in ("id", "row", "text", "blobs")], strict=True):
                wanted = np.concatenate([_unpack(b, CANDIDATE) for b in blobs])
                wanted = wanted[wanted["lo"] + wanted["more"] + WINDOW <= len(text)]
                singles += [(id_, tag, int(c["lo"]), text[c["lo"] : int(c["lo"]) + int(c["more"]) + WINDOW]) for c in wanted[wanted["crowded"] == 1]]
                plain = wanted[wanted["crowded"] == 0]
                table = np.zeros(len(plain), CONTEXT)
                table["key"], table["doc"], table["row"], table["lo"], table["more"] = plain["key"], id_, tag, plain["lo"], plain["more"]
                data = np.frombuffer(text, np.uint8)
                for row, c in zip(table, plain, strict=True):
                    size = int(c["more"]) + WINDOW
                    row["bytes"][:size] = data[c["lo"] : c["lo"] + size]
                tables.append(table)
            spread = _firsts_of_singles(_singles(singles), out, buckets)
            out.dealt(SINGLES, spread["w1"], spread, buckets)
            table = np.concatenate(tables) if tables else np.empty(0, CONTEXT)
            bucket = (table["key"] >> np.uint64(40)) % np.uint64(buckets)
            for b in np.unique(bucket):
                out.rows.append((CONTEXTS, int(b), None, table[bucket == b].tobytes()))
            yield from out.batches()

    return batches


def _compared(buckets: int):
    """Step 3, at the shards: windows of contexts and single windows to marks."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, singles, contexts = _Out(), [], []
        for part in parts:
            for kind, blob in zip(part.column("kind").to_pylist(), part.column("blob").to_pylist(), strict=True):
                if kind == SINGLES:
                    singles.append(_unpack(blob, SINGLE))
                elif kind == CONTEXTS:
                    contexts.append(np.frombuffer(blob, CONTEXT))
                else:
                    raise ValueError(kind)
        if singles:
            _firsts_of_singles(np.concatenate(singles), out, buckets)
            singles.clear()
            yield from out.batches()
        table = np.concatenate(contexts) if contexts else np.empty(0, CONTEXT)
        contexts.clear()
        rounds = int(table["more"].sum(dtype=np.int64) + len(table)) // AT_ONCE + 1
        turn = (table["key"] >> np.uint64(8)) % np.uint64(rounds)
        for r in range(rounds):
            rows = table[turn == r]
            _firsts_of_singles(
                _singles((int(c["doc"]), int(c["row"]), int(c["lo"]), c["bytes"][: int(c["more"]) + WINDOW].tobytes()) for c in rows), out, buckets
            )
            yield from out.batches()

    return batches


def _spans(rows: DataFrame, buckets: int, shards: int) -> DataFrame:
    """rows: doc_id, text, row. row, blobs: the spans to remove by row, packed, those of a shard in one."""
    id_ = F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("id")
    long_ones = rows.where(F.octet_length("text") >= WINDOW).select(id_, "row", "text")
    scanned = stage(
        long_ones.mapInArrow(_runs(buckets), ROWS).repartition(shards, "bucket").mapInArrow(_shards(buckets), ROWS), "suffix-shards"
    )
    wanted = scanned.where(F.col("kind") == CANDIDATES).groupBy(F.col("id").alias("row")).agg(F.collect_list("blob").alias("blobs"))
    contexts = long_ones.join(wanted, "row").mapInArrow(_contexts(buckets), ROWS)
    passed = F.col("kind").isin(SPANS)
    single = scanned.where(F.col("kind") == SINGLES)
    # marks that the contexts' step makes itself go straight on with those of the shards
    compared = stage(
        contexts.unionByName(single).repartition(shards, "bucket").mapInArrow(_passing(_compared(buckets)), ROWS), "suffix-compared"
    )
    marks = scanned.where(passed).unionByName(compared.where(passed))
    spans = stage(marks.groupBy(F.col("id").alias("row")).agg(F.collect_list("blob").alias("blobs")), "suffix-spans")
    for done in (scanned, compared):
        unstage(done)
    return spans


def _passing(step):
    """A step that lets marks through."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing: list[pa.RecordBatch] = []

        def others() -> Iterator[pa.RecordBatch]:
            for part in parts:
                marks = part.column("kind").to_numpy() == SPANS
                if marks.any():
                    passing.append(part.filter(pa.array(marks)))
                yield part.filter(pa.array(~marks))

        yield from step(others())
        yield from passing

    return batches


def _cut(text: bytes, blobs: list[bytes] | None) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs of a text, and the bytes that stay."""
    spans = np.concatenate([_unpack(b, SPAN) for b in blobs]) if blobs else np.empty(0, SPAN)
    runs = [(int(s), min(int(e), len(text))) for s, e in merged(spans["start"], spans["end"]) if s < len(text)]
    edges = [0, *[x for run in runs for x in run], len(text)]
    return runs, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _joined(docs: DataFrame) -> DataFrame:
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number of a row must stay the same in all passes over the texts
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.monotonically_increasing_id().alias("row"))
    rows = stage(numbered, "suffix-documents")
    return rows.join(_spans(rows, 4 * shards, shards), "row", "left")


def suffix_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of what stays)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, removed, counts, digests = [], [], [], []
            for text, blobs in zip(part.column("text").to_pylist(), part.column("blobs").to_pylist(), strict=True):
                runs, kept = _cut(text or b"", blobs)
                sizes.append(len(text or b""))
                removed.append(sizes[-1] - len(kept))
                counts.append(len(runs))
                digests.append(hashlib.sha256(kept).hexdigest())
            columns = [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in (sizes, removed, counts)], pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _joined(docs).mapInArrow(batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the bytes that stay (kept), and the removed runs as places in the input's bytes (spans)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cut = [_cut(t or b"", b) for t, b in zip(part.column("text").to_pylist(), part.column("blobs").to_pylist(), strict=True)]
            spans = [[{"start": a, "end": b} for a, b in runs] for runs, _ in cut]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [part.column("doc_id"), pa.array([k for _, k in cut], pa.binary()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "spans"])

    return _joined(docs).mapInArrow(batches, "doc_id long, kept binary, spans array<struct<start:int,end:int>>")


ship(__name__)
