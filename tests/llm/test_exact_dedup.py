from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaymetrics.llm import exact_dedup as e


def brute(rows):
    """Sorted rows; of rows equal in text and doc_id, which are alike in the result, the last one stays."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i))
        for k, i in enumerate(ids):
            out.append((i, ids[-1], len(ids), k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(5))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(1000 + i, "the hot one") for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, "Case"), (2003, "case"), (2004, "x" * 300_000), (2005, "x" * 300_000)]
    rows += [(7, "twice whole"), (7, "twice whole"), (6, "twice whole"), (None, "no id"), (None, "no id"), (3, "no id"), (None, "nothing known"), (None, "nothing known"), (None, "alone")]
    return rows


@pytest.mark.parametrize("capacity", [e.CAPACITY, 2000, 1])
def test_equals_brute_force(spark, make_docs, capacity):
    rows = cases()
    got = e.equal_texts(make_docs(rows).repartition(5), capacity=capacity)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_row_of_each_text_stays_with_all_its_columns(spark, make_docs):
    rows = cases()
    docs = make_docs(rows).withColumns({"_id": F.lit(1), "_digest": F.lit("x"), "_keep": F.lit(2), "content": F.lit("y")})
    kept = e.drop_equal_texts(docs.repartition(4))
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str)
    largest = {}
    for i, text in rows:
        largest[text or ""] = max(largest.get(text or "", -1), -1 if i is None else i)
    assert got == sorted(((None if i < 0 else i, text) for text, i in largest.items()), key=str)


def test_texts_may_be_made_alike_first(spark, make_docs):
    rows = [(1, "A  b"), (2, "a b "), (3, "ab"), (4, None), (5, " ")]
    got = e.equal_texts(make_docs(rows), normalise=lambda t: F.trim(F.regexp_replace(F.lower(t), " +", " ")))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()) == [
        (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True),
    ]


def test_no_documents(spark, make_docs):
    assert e.equal_texts(make_docs(cases()).limit(0)).collect() == []
    assert e.drop_equal_texts(make_docs(cases()).limit(0)).collect() == []


def test_equal_hashes_of_different_contents_are_told_apart():
    table = e.ContentTable()
    for k in range(3000):
        assert table.add(5, str(k % 1500).encode(), k, 1, 1)
    assert len(table.contents) == 1500 and set(c[1] for c in table.counts) == {2}
    assert table.counts[table.contents.index(b"7")] == (1507, 2, 1)


def test_a_full_table_still_counts_what_it_holds_and_takes_nothing_new():
    table = e.ContentTable(capacity=2 * (e.OVERHEAD + 10))
    assert table.add(1, b"a" * 10, 1, 1, 1) and table.add(2, b"b" * 10, 2, 1, 1)
    assert not table.add(3, b"c" * 10, 3, 1, 1)
    assert not table.add(4, b"", 4, 1, 1)  # small enough, but an earlier copy may have been refused
    assert table.add(1, b"a" * 10, 9, 4, 2) and table.counts[0] == (9, 5, 2)


def test_counts_of_the_largest_id():
    assert e.merged((3, 2, 1), (3, 4, 4)) == (3, 6, 5)
    assert e.merged((None, 2, 2), (3, 1, 1)) == (3, 3, 1)
    assert e.merged((3, 1, 1), (None, 2, 2)) == (3, 3, 1)
    assert e.merged((None, 2, 2), (None, 1, 1)) == (None, 3, 3)
    assert e.merged((4, 1, 1), (3, 2, 2)) == (4, 3, 1)


def test_few_records_are_held_as_python_values():
    """A batch of many rows is taken out of Arrow's memory in slices, in order."""
    n = 3 * e.TAKEN + 1
    columns = {"key": range(n), "content": [str(i) for i in range(n)], "largest": range(n), "n_rows": [1] * n, "of_largest": [1] * n}
    batch = pa.record_batch({name: pa.array(list(values)) for name, values in columns.items()})

    class Watched:
        num_rows, taken = n, []

        def slice(self, at, length):
            self.taken.append(length)
            return batch.slice(at, length)

    assert list(e._records(Watched())) == [(i, str(i).encode(), i, 1, 1) for i in range(n)]
    assert max(Watched.taken) == e.TAKEN
