"""Exact dedup by Grace hashing: records go into buckets by hash until a bucket fits a table that compares whole contents.

1. Each task that reads documents puts them into an open-addressing table and passes on one record a content: its largest
   doc_id, how many rows it has, and how many of these have that doc_id. So a content that has a million copies travels
   once a task. A table that has reached `CAPACITY` is passed on and begun anew.
2. Records are dealt into buckets by hash, one task a bucket. Its table takes contents until it is full; from then on only
   records of contents that it holds are added. Those are complete, since a content's records share a bucket.
3. All other records of a bucket are written to spill files, in the shared folder, dealt into buckets by another hash,
   and so on until nothing is left over. A table takes at least one content, so each round finishes some.
4. Contents met twice are kept as groups, under their SHA-256; documents look up their group by it.

What is written to the shared folder can be read again when executors are lost.

Defined cases: a null text is empty, and empty texts are equal; a null doc_id is less than any; of rows equal in text and
doc_id one stays; extra columns don't matter, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.common import ship, stage

#: Bytes of contents, and what a table needs for each of them besides, that a table takes.
CAPACITY = 24 << 20
OVERHEAD = 200
#: Records that are taken out of Arrow's memory at a time.
TAKEN = 500


class ContentTable:
    """Contents with their largest id, number of rows, and number of rows of that id: open addressing, linear probing."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.clear()

    def clear(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.counts: list[tuple] = []
        self.bytes, self.full = 0, False

    def _slot(self, key: int, content: bytes) -> int:
        """The slot of a content, or the free one that it would take. Equal hashes don't make equal contents."""
        at = key & self.mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                break
            at = (at + 1) & self.mask
        return at

    def add(self, key: int, content: bytes, largest, rows: int, of_largest: int) -> bool:
        """Whether the record was taken. A table that has refused one takes no further contents."""
        at = self._slot(key, content)
        entry = self.slots[at]
        if entry >= 0:
            self.counts[entry] = merged(self.counts[entry], (largest, rows, of_largest))
            return True
        size = len(content) + OVERHEAD
        if self.full or self.contents and self.bytes + size > self.capacity:
            self.full = True
            return False
        self.slots[at] = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        self.counts.append((largest, rows, of_largest))
        self.bytes += size
        if 2 * len(self.contents) > self.mask:
            self._grow()
        return True

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = [-1] * (self.mask + 1)
        for entry, key in enumerate(self.hashes):  # all contents differ: any free slot will do
            at = key & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


def merged(a: tuple, b: tuple) -> tuple:
    """Counts of the rows of both: a null id is less than any."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    above = b[0] is None or (a[0] is not None and a[0] > b[0])
    return (a[0], a[1] + b[1], a[2]) if above else (b[0], a[1] + b[1], b[2])


def _records(part: pa.RecordBatch) -> Iterator[tuple]:
    for at in range(0, part.num_rows, TAKEN):
        some = part.slice(at, TAKEN)
        contents = some.column("content").cast(pa.binary()).to_pylist()
        others = [some.column(c).to_pylist() for c in ("key", "largest", "n_rows", "of_largest")]
        for key, content, *counts in zip(others[0], contents, *others[1:]):
            yield key, content, *counts


def _combining(capacity: int):
    def combined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, schema = ContentTable(capacity), None

        def held() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(table.contents), 1024):
                some = slice(at, at + 1024)
                columns = [table.hashes[some], table.contents[some], *zip(*table.counts[some])]
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema)

        for part in parts:
            schema = part.schema
            for record in _records(part):
                if not table.add(*record):
                    yield from held()
                    table.clear()
                    table.add(*record)
        yield from held()

    return combined


def _resolving(capacity: int):
    """Rows of two kinds: groups, without a content, and records to be spilled, without a digest."""

    def resolved(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, schema = ContentTable(capacity), None

        def rows(records: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*records), schema)], schema)

        for part in parts:
            schema = pa.schema([*part.schema, pa.field("digest", pa.string())])
            spilled = [(*record, None) for record in _records(part) if not table.add(*record)]
            if spilled:
                yield rows(spilled)
        groups = [
            (key, None, *counts, hashlib.sha256(content).hexdigest())
            for key, content, counts in zip(table.hashes, table.contents, table.counts)
            if counts[1] > 1
        ]
        for at in range(0, len(groups), 10_000):
            yield rows(groups[at : at + 10_000])

    return resolved


def groups_of_equals(records: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """records: content, id. digest, largest, n_rows and of_largest of each content that has two rows or more."""
    ship(__name__)
    kind = records.schema["id"].dataType.simpleString()
    schema = f"key long, content string, largest {kind}, n_rows long, of_largest long"
    one = F.lit(1).cast("long")
    keyed = records.select(F.xxhash64("content").alias("key"), "content", F.col("id").alias("largest"), one.alias("n_rows"), one.alias("of_largest"))
    left = keyed.mapInArrow(_combining(capacity), schema)
    found, spill, level = None, None, 0
    while level == 0 or not spill.isEmpty():
        # another hash in each round: the records of one bucket part company
        buckets = left.repartition(F.xxhash64("key", F.lit(level)))
        level += 1
        written = stage(buckets.mapInArrow(_resolving(capacity), f"{schema}, digest string"), f"exact-level-{level}")
        groups = written.where("content is null").select("digest", "largest", "n_rows", "of_largest")
        found = groups if found is None else found.unionByName(groups)
        left = spill = written.where("content is not null").drop("digest")
    return found


def _members(docs: DataFrame, text: Column, *others: Column) -> DataFrame:
    number = F.monotonically_increasing_id().alias("_number")
    return docs.select(F.col("doc_id").alias("_id"), F.sha2(text, 256).alias("_digest"), number, *others)


def _judged(members: DataFrame, records: DataFrame, capacity: int) -> DataFrame:
    """Staged members with _keep, _size and _kept; records: their contents and ids."""
    found = groups_of_equals(records, capacity)
    found = found.select(F.col("digest").alias("_digest"), F.col("largest").alias("_keep"), F.col("n_rows").alias("_size"), "of_largest")
    # of rows that have the text and the largest doc_id in common, the first one stays
    tied = members.join(found.where("of_largest > 1"), "_digest").where(F.col("_id").eqNullSafe(F.col("_keep")))
    first = tied.groupBy("_digest").agg(F.min("_number").alias("_first"))
    groups = found.join(first, "_digest", "left")
    rows = members.join(groups, "_digest", "left")
    alone = F.col("_size").isNull()
    chosen = F.col("_id").eqNullSafe(F.col("_keep")) & ((F.col("of_largest") == 1) | (F.col("_number") == F.col("_first")))
    return rows.withColumns({
        "_keep": F.when(alone, F.col("_id")).otherwise(F.col("_keep")),
        "_size": F.coalesce("_size", F.lit(1).cast("long")),
        "_kept": alone | chosen,
    }).drop("of_largest", "_first", "_number")


def unchanged(text: Column) -> Column:
    return text


def equal_texts(docs: DataFrame, normalise: Callable[[Column], Column] = unchanged, capacity: int = CAPACITY) -> DataFrame:
    """One row a document: doc_id, keep_id (of the row that stays of all with that text), group_size, kept, text_sha256."""
    text = F.coalesce(normalise(F.col("text")), F.lit(""))
    members = stage(_members(docs, text), "exact-members")
    records = docs.select(text.alias("content"), F.col("doc_id").alias("id"))
    return _judged(members, records, capacity).select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"),
    )


def drop_equal_texts(docs: DataFrame, normalise: Callable[[Column], Column] = unchanged, capacity: int = CAPACITY) -> DataFrame:
    """The documents, with all their columns, but for equal texts: of these the row with the largest doc_id stays."""
    text = F.coalesce(normalise(F.col("text")), F.lit(""))
    members = stage(_members(docs, text, F.struct(*docs.columns).alias("_row")), "exact-documents")
    whole = members.select("_row.*")
    records = whole.select(text.alias("content"), F.col("doc_id").alias("id"))
    return _judged(members, records, capacity).where("_kept").select("_row.*")
