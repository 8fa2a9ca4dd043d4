"""Quality rules: plain counts first, then a log-likelihood ratio of hashed n-grams between trusted texts and the corpus.

The n-grams are the words, all their characters, and the pairs of neighbouring words, hashed into `BUCKETS` buckets. Two multinomials over the buckets are estimated: the corpus's from all documents, the target's from trusted ones.
Both are smoothed in proportion, so that a bucket's weight is log((t + K) / (s r + K)), t and r being its counts and s the
target's share of all n-grams: little evidence gives a weight near zero. A text's score is the mean weight of its n-grams;
it is kept from `THRESHOLD` on. Weights are fixed-point numbers, so that sums and verdicts don't depend on the order of rows.

Trusted texts are those labelled 1: a bounded sample of `TRUSTED` ids, those with the least hash, if there are more.
The table of weights, one row a bucket, and the trusted ids are broadcast; both are bounded by their parameters.

Repeated windows of a text are found by 64-bit hashes of its windows.

Defined cases: null and wordless texts have no words and fail the plain rules; without trusted texts all weights are
zero; rows equal in all columns are rows of their own; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.common import BLANKS, stage, words

BUCKETS = 1 << 16
K = 0.5
THRESHOLD = -0.25
TRUSTED = 20_000
#: Fixed-point units of a weight.
UNITS = 1 << 20
LEAST_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"


def _grams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and bucket: one row an n-gram of the words; one row with a null bucket where there are no words."""
    n = F.size("hashes")
    hashed = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    slots = F.when(n > 0, F.sequence(F.lit(0), 2 * n - 2))
    spread = hashed.select(*keys, "hashes", n.alias("n"), F.explode_outer(slots).alias("slot"))
    single = F.col("slot") < F.col("n")
    at = F.col("slot") - F.col("n")
    pair = F.xxhash64(F.get("hashes", at), F.get("hashes", at + 1))
    # single words and pairs fall into buckets by independent hashes
    gram = F.when(single, F.xxhash64(F.lit(1), F.get("hashes", F.col("slot")))).otherwise(pair)
    bucket = F.when(F.col("n") > 0, gram.bitwiseAND(BUCKETS - 1).cast("int"))
    return spread.select(*keys, bucket.alias("bucket"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """doc_ids labelled 1, `most` of them at most."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, weight (fixed-point): trusted has at most TRUSTED doc_ids."""
    marked = F.broadcast(trusted.withColumn("t", F.lit(1)))
    rows = docs.join(marked, "doc_id", "left").select(F.coalesce("t", F.lit(0)).alias("t"), words(F.col("text")).alias("words"))
    counts = stage(
        _grams(rows, ["t"]).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("r"), F.sum("t").alias("t")),
        "buckets",
    )
    share = counts.agg((F.sum("t") / F.sum("r")).alias("s")).first()["s"] or 0.0
    weight = F.log(F.col("t") + K) - F.log(F.col("r") * share + K)
    return counts.select("bucket", F.round(weight * UNITS).cast("long").alias("weight"))


def _measured(docs: DataFrame) -> DataFrame:
    """Per row its number (row), doc_id, words, and the plain counts."""
    text = F.coalesce("text", F.lit(""))
    start = docs.select("doc_id", text.alias("text"), words(text).alias("words"), F.monotonically_increasing_id().alias("row"))
    filled = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))
    hashed = start.select(
        "row", "doc_id", "words", F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        filled.alias("filled"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    h = F.col("hashes")
    windows = F.when(F.size(h) >= 3, F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2])))
    seen = hashed.select(
        "row", "doc_id", "words", "n_symbols", (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = seen.select("row", "doc_id", "words", "n_symbols", "n_dup_lines", F.when(repeats, placed).alias("placed"))
    p = F.col("placed")
    twice = F.filter(p, lambda x, j: F.coalesce(F.get(p, j - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["w"] == x["w"], F.lit(False)))
    found = ordered.select(
        "row", "doc_id", "words", "n_symbols", "n_dup_lines", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at")
    )
    at = F.col("at")
    fresh = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
    return found.select(
        "row", "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate(fresh, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """Per row: doc_id, n_words, the plain counts, base_failed, kept, score (mean weight of the n-grams, 0 without any)."""
    weights = F.broadcast(bucket_weights(docs, trusted_ids(labels, trusted)))
    plain = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    grams = _grams(_measured(docs), ["row", "doc_id", *plain])
    total = grams.join(weights, "bucket", "left").groupBy("row", "doc_id", *plain).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("sum"))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    enough = F.col("sum") >= n * int(threshold * UNITS)
    return total.select(
        "doc_id", *plain, base_failed().alias("base_failed"), (~base_failed() & enough).alias("kept"), (F.col("sum") / n / UNITS).alias("score")
    )
