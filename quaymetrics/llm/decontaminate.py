"""Benchmark decontamination: find every window of benchmark words in the documents, then drop documents or cut spans.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A benchmark item gives all windows of
ten consecutive words; a shorter item is one window of its own length.

Documents look the hashes of their windows up in a broadcast set of the benchmark's hashes, kept as a blocked Bloom filter: at
most 2**`CELL_BITS` cells of 64 bits, whatever the benchmark's size, with four bits of one cell a window. What it lets through
takes its own words along, no others, and is joined with the benchmark's windows on hash and words; Spark broadcasts these or
shuffles, by size. False hits end there: about one window in 10,000 for a million benchmark windows, one in 20 for ten million.

Defined cases: null and wordless texts and items have no words and no hits; repeated items count once by item_id; rows
equal in doc_id and text get the same result; null item_ids are not named among the items, but their windows hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.common import ascii_lower, row_key, same_row, stage, words

WINDOW = 10
#: The set of hashes has at most 2**CELL_BITS cells (about 70 MB broadcast).
CELL_BITS = 20
#: What stands between words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _hashed(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _window_hash(at: Column, length: int) -> Column:
    return F.xxhash64(*[F.col("hashes")[at + i] for i in range(length)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: hash h, length, the words joined by spaces, and the item_ids that have them."""
    last = F.greatest(F.size("words") - window, F.lit(0))
    spread = (
        benchmark.select("item_id", words(ascii_lower(F.col("text")), BETWEEN).alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item_id", F.slice("words", F.col("at") + 1, window).alias("gram"))
    )
    by_length = F.coalesce(
        *[F.when(F.size("gram") == n, F.xxhash64(*[F.col("hashes")[i] for i in range(n)])) for n in range(1, window + 1)]
    )
    return (
        spread.groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .withColumn("hashes", _hashed(F.col("gram")))
        .select(by_length.alias("h"), F.size("gram").alias("length"), F.array_join("gram", " ").alias("gram"), "items")
    )


def _cell(h: Column, cell_bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << cell_bits) - 1))


def _bits(h: Column) -> Column:
    """Four of 64 bits, by the four topmost groups of six bits of the hash."""
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return one(40).bitwiseOR(one(46)).bitwiseOR(one(52)).bitwiseOR(one(58))


def _sieve(grams: DataFrame, cell_bits: int) -> DataFrame:
    """The hashes as cells and their bits, 2**cell_bits rows at most."""
    return grams.groupBy(_cell(F.col("h"), cell_bits).alias("cell")).agg(F.bit_or(_bits(F.col("h"))).alias("bits"))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, cell_bits: int) -> DataFrame:
    """Per row key with hits: spans (at, length) in words, sorted, and the item_ids."""
    grams = stage(item_windows(benchmark, window), "benchmark-windows")
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect()) or [window]  # at most `window`
    slot = F.col("slot") % len(lengths)
    at = F.floor(F.col("slot") / len(lengths)).cast("int") if len(lengths) > 1 else F.col("slot")
    size = F.size("hashes")
    found, length = F.lit(None).cast("long"), F.lit(lengths[0])
    for i, n in enumerate(lengths):
        found = F.when((slot == i) & (F.col("at") + n <= size), _window_hash(F.col("at"), n)).otherwise(found)
        length = F.when(slot == i, n).otherwise(length)
    places = (
        docs.where(F.col("text").isNotNull())
        .select(*row_key(), words(ascii_lower(F.col("text")), BETWEEN).alias("words"))
        .where(F.size("words") >= lengths[0])
        .select("id", "digest", "words", _hashed(F.col("words")).alias("hashes"))
        .select("id", "digest", "words", "hashes", F.explode(F.sequence(F.lit(0), (size - lengths[0] + 1) * len(lengths) - 1)).alias("slot"))
        .withColumn("at", at)
        .select("id", "digest", "words", "at", found.alias("found"), length.alias("n"))
    )
    held = _bits(F.col("found"))
    passed = (
        places.join(F.broadcast(_sieve(grams, cell_bits)), (_cell(F.col("found"), cell_bits) == F.col("cell")) & (held.bitwiseAND(F.col("bits")) == held))
        .select("id", "digest", "at", "found", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("own"))
    )
    # a hash with its length in words says nothing that hash and words don't
    return (
        passed.join(grams, (F.col("found") == grams["h"]) & (F.col("own") == grams["gram"]))
        .groupBy("id", "digest")
        .agg(
            F.sort_array(F.collect_set(F.struct("at", "length"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(state, span):
        end = span["at"] + span["length"]
        fresh = F.greatest(end - F.greatest(state["end"], span["at"]), F.lit(0))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, step, lambda state: state["n"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cell_bits: int = CELL_BITS
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted item_ids, comma-joined), contaminated."""
    hits = _hits(docs, benchmark, window, cell_bits)
    counted = docs.select(*row_key(), F.size(words(F.col("text"), BETWEEN)).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    return counted.join(hits, same_row(counted, hits), "left").select(
        counted["id"].alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cell_bits: int = CELL_BITS
) -> DataFrame:
    """The rows of docs without any hit."""
    hits = _hits(docs, benchmark, window, cell_bits).select("id", "digest")
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    return rows.join(hits, same_row(rows, hits), "left_anti").select("row.*")


def cut_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cell_bits: int = CELL_BITS
) -> DataFrame:
    """docs with every hit word, and what stands between words of one span, cut out of the texts."""
    hits = _hits(docs, benchmark, window, cell_bits).select("id", "digest", "spans")
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    # words at odd places, what stands between them at even ones; both ends are gaps, perhaps empty
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    joined = rows.join(hits, same_row(rows, hits), "left").select(
        "row", "spans",
        F.split("row.text", word).alias("gaps"), F.regexp_extract_all("row.text", F.lit(f"({word})"), 1).alias("found"),
    )
    merged = joined.withColumn("runs", _merged(F.col("spans")))
    n, runs = F.size("found"), F.size("runs")
    start = lambda j: F.when(j == 0, 0).otherwise(F.col("runs")[F.greatest(j - 1, F.lit(0))]["end"])
    end = lambda j: F.when(j == runs, n).otherwise(F.col("runs")[F.least(j, runs - 1)]["at"])
    piece = lambda i: F.concat(F.col("gaps")[i], F.col("found")[i])
    kept = F.transform(
        F.sequence(F.lit(0), runs),
        lambda j: F.concat(
            F.array_join(F.transform(F.slice(F.sequence(F.lit(0), n), start(j) + 1, end(j) - start(j)), piece), ""),
            F.col("gaps")[end(j)],
        ),
    )
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(kept, ""))
    return merged.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def _merged(spans: Column) -> Column:
    """Sorted spans of words as runs (at, end) that do not touch."""
    ends = F.transform(
        F.sequence(F.lit(0), F.size(spans) - 1),
        lambda i: F.struct(spans[i]["at"].alias("at"), (spans[i]["at"] + spans[i]["length"]).alias("end")),
    )
    empty = F.array().cast("array<struct<at:int,end:int>>")

    def step(runs, span):
        last = F.element_at(runs, -1)
        wider = F.struct(last["at"].alias("at"), F.greatest(last["end"], span["end"]).alias("end"))
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(wider))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] >= span["at"]), joined).otherwise(
            F.concat(runs, F.array(span))
        )

    return F.aggregate(ends, empty, step)
