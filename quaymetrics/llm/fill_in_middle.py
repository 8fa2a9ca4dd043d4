"""Fill-in-middle: a text cut at two places and written prefix, suffix, middle (or suffix first), or left as it is.

Where a text is cut is given in code points, while a text comes as UTF-8 bytes. Nobody counts a passage twice that many
texts share:

1. A rolling hash over `WINDOW` bytes cuts the bytes into chunks where its bits say so. It looks at content alone, so a
   passage gives the same chunks in every text, whatever stands before it.
2. A task remembers what it knows of a chunk: the number of code points that begin in it, whether it holds a sentinel, and
   the few bytes at both its ends. It is looked up by hash and taken only if the whole content agrees.
3. Added up, the chunks' counts say which chunk holds a cut; only that one is searched for the byte. Ends of neighbouring
   chunks, put together, show sentinels that stand across a border.

Tasks share nothing, so a lost one is simply run again. Memory is bounded: bytes are hashed in strips and the memo holds
`MEMO_BYTES` at most, oldest out first. What it holds or forgets changes the speed only.

Defined cases: a null text is empty; empty texts and texts that hold a sentinel stay plain; a null doc_id is hashed as an
empty number; rows of one doc_id have the same cuts if they are equally long; rows equal in all columns are rows of their
own; other columns stay as they are, but for one of the name that the result takes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quaymetrics.llm.common import ship

#: Prefix, suffix and middle follow these.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are rearranged, and of 100 of those so many with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1

WINDOW = 16
#: Least, usual (2 to this power) and most bytes of a chunk.
LEAST, USUAL_BITS, MOST = 64, 9, 8192
STRIP = 1 << 20
MEMO_BYTES = 16 << 20

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)
_MASK = np.uint32(((1 << USUAL_BITS) - 1) << WINDOW)
_CONTINUED = bytes(range(0x80, 0xC0))
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


class Summary(NamedTuple):
    points: int
    holds: bool
    head: bytes
    tail: bytes


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last `WINDOW` bytes asks for a cut."""
    found = []
    for at in range(0, len(data), STRIP):
        before = min(at, WINDOW - 1)
        rolled = _GEAR[data[at - before : at + STRIP]]
        width = 1
        while width < WINDOW:  # hashes of twice as many bytes from two of half as many
            longer = rolled.copy()
            longer[width:] += rolled[:-width] << np.uint32(width)
            rolled, width = longer, 2 * width
        places = np.flatnonzero((rolled & _MASK) == 0) + 1
        found.append(places[places > before] + at - before)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(places: Sequence[int], start: int, end: int) -> list[int]:
    """Ends of a text's chunks, each `LEAST` to `MOST` bytes long but for the last one."""
    ends, at = [], start
    for place in [*places, end]:
        while place - at > MOST:
            at += MOST
            ends.append(at)
        if place - at >= LEAST and place < end:
            ends.append(at := place)
    return [*ends, end] if at < end else ends


class ChunkMemo:
    """Summaries of chunks by content, as many as `limit` bytes of chunks allow."""

    def __init__(self, sentinels: Sequence[bytes], limit: int = MEMO_BYTES) -> None:
        self.sentinels, self.limit = sentinels, limit
        self.reach = max(map(len, sentinels)) - 1
        self.held: OrderedDict[int, tuple[bytes, Summary]] = OrderedDict()
        self.bytes = self.hits = 0

    def summary(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        known = self.held.get(key)
        if known and known[0] == chunk:
            self.held.move_to_end(key)
            self.hits += 1
            return known[1]
        made = self._made(chunk)
        if not known:  # another content of the same hash keeps its place
            self.held[key] = chunk, made
            self.bytes += len(chunk)
            while self.bytes > self.limit:
                self.bytes -= len(self.held.popitem(last=False)[1][0])
        return made

    def _made(self, chunk: bytes) -> Summary:
        points = len(chunk) if chunk.isascii() else len(chunk.translate(None, _CONTINUED))
        return Summary(points, any(s in chunk for s in self.sentinels), chunk[: self.reach], chunk[-self.reach :])


class ChunkedText:
    """A text's bytes as chunks: its length in code points, whether it holds a sentinel, where its code points begin."""

    def __init__(self, data: memoryview, start: int, ends: Sequence[int], memo: ChunkMemo) -> None:
        self.data, self.bounds = data, [start, *ends]
        known = [memo.summary(bytes(data[a:b])) for a, b in zip(self.bounds, ends)]
        self.counts = list(accumulate((s.points for s in known), initial=0))
        self.n = self.counts[-1]
        self.holds = any(s.holds for s in known)
        left = b""
        for s in known if not self.holds else ():
            self.holds |= any(x in left + s.head for x in memo.sentinels)
            left = (left + s.tail)[-memo.reach :]

    def byte_of(self, point: int) -> int:
        """Where a code point begins; the end for their number."""
        if point == self.n:
            return self.bounds[-1]
        chunk = bisect_right(self.counts, point) - 1
        start, end = self.bounds[chunk], self.bounds[chunk + 1]
        if end - start == self.counts[chunk + 1] - self.counts[chunk] and bytes(self.data[start:end]).isascii():
            return start + point - self.counts[chunk]
        begins = np.flatnonzero((np.frombuffer(self.data[start:end], np.uint8) & 0xC0) != 0x80)
        return start + int(begins[point - self.counts[chunk]])


def _transform(sentinels: Sequence[str], rate: int, suffix_first: int):
    marks = [s.encode() for s in sentinels]

    @arrow_udf(_RESULT)
    def transformed(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        memo = ChunkMemo(marks)
        for texts, draws in parts:
            if texts.null_count:
                texts = texts.fill_null("")
            buffers = texts.buffers()
            wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            offsets = np.frombuffer(buffers[1], wide)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, wide)
            data = np.frombuffer(buffers[2] or b"", np.uint8)[: offsets[-1]]
            places, view = cut_places(data), memoryview(data)
            borders = np.searchsorted(places, offsets, "right")
            rows = []
            for k, (h1, h2, h3, h4) in enumerate(zip(*[draws.field(f).to_pylist() for f in ("h1", "h2", "h3", "h4")])):
                start, end = int(offsets[k]), int(offsets[k + 1])
                text = ChunkedText(view, start, chunk_ends(places[borders[k] : borders[k + 1]].tolist(), start, end), memo)
                n = text.n
                if not n or text.holds or h3 % 100 >= rate:
                    rows.append((n, "plain", None, None, bytes(view[start:end])))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = text.byte_of(low), text.byte_of(high)
                prefix, middle, suffix = view[start:a], view[a:b], view[b:end]
                form = "spm" if h4 % 100 < suffix_first else "psm"
                first, second = (prefix, suffix) if form == "psm" else (suffix, prefix)
                order = marks if form == "psm" else (marks[1], marks[0], marks[2])
                rows.append((n, form, low, high - low, b"".join((order[0], first, order[1], second, order[2], middle))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.StructArray.from_arrays(columns, [f.split()[0] for f in _RESULT.split(", ")])

    return transformed


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers from the hash of seed and doc_id: h1 and h2 place the cuts, h3 and h4 choose the form."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.struct(*[
        F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)
    ])


def fill_in_middle(
    docs: DataFrame,
    into: str = "fim",
    sentinels: Sequence[str] = SENTINELS,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    seed: int = SEED,
) -> DataFrame:
    """docs with a struct: n (code points of text), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Sentinels follow for prefix, suffix and middle. Their first character must occur nowhere else in them: so none can
    arise across the border of a sentinel and a text, and an output can be read back.
    """
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("three different sentinels, which begin with characters that none of them has further on")
    ship(__name__)
    transformed = _transform(tuple(sentinels), rate, suffix_first)
    return docs.withColumn(into, transformed(F.col("text"), draws(F.col("doc_id"), seed)))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text read back from it."""
    rows = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    back = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    digests = [F.sha2("output", 256).alias("output_sha256"), back]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
