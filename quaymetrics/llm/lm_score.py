"""LM scoring: the log-probability of a text, summed over all ways to cut its words into pieces of a given vocabulary.

A unigram model gives each piece of an existing public vocabulary a probability. A word's probability is the sum, over all
its segmentations into pieces, of the products of their probabilities; a forward recursion in log space over the word's
bytes adds them up. Bytes themselves are pieces, so every text has a probability. A text's is the product over its words
and one end mark.

Learned from the training rows: how often each word occurs, and from that how often each piece does when the vocabulary's
own tokenizer cuts the words. The scores that the vocabulary brings (merge ranks, in the public file) are the prior:
`PRIOR` pseudo-counts fall off with the rank. The tokenizer itself is not trained.

Every distinct word of the table is counted and scored once, in a table that grows with the corpus. Texts find the most
frequent words, `HEAD` at most, in a broadcast list; the others meet their words in a join.

Defined cases: a null text is empty and has its end mark only; a null doc_id counts as training; rows equal in all columns
are rows of their own; without training rows counts are zero and the prior alone gives scores; other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymetrics.llm.common import ship, stage

#: Words in the broadcast list at most.
HEAD = 100_000
PRIOR = 16_000.0
#: Bytes of a long word whose pieces are looked up at once.
PIECE = 1 << 15
#: Where a word begins, in the vocabulary's writing.
START = "▁".encode()
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def vocabulary(model: str) -> list[bytes | None]:
    """The bytes of each piece; None for pieces that write nothing. `model` is a sentencepiece file."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out: list[bytes | None] = []
    for i in range(sp.vocab_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            out.append(None)
        elif sp.is_byte(i):
            out.append(bytes([int(sp.id_to_piece(i)[3:-1], 16)]))
        else:
            out.append(sp.id_to_piece(i).encode())
    return out


def prior_counts(model: str) -> np.ndarray:
    """PRIOR pseudo-counts over the pieces, falling with the rank that the vocabulary's scores give; one for the end."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    writes = np.array([p is not None for p in vocabulary(model)] + [True])
    scores = np.array([sp.get_score(i) for i in range(sp.vocab_size())] + [0.0])
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    share = np.where(writes, 1 / (rank + 100), 0)
    return PRIOR * share / share.sum()


def _log_sum(logs: list[float]) -> float:
    best = max(logs, default=-math.inf)
    return best + math.log(sum(math.exp(x - best) for x in logs)) if best > -math.inf else best


class Lattice:
    """Log10-probabilities of words over all their segmentations."""

    def __init__(self, pieces: list[bytes | None], logs: np.ndarray) -> None:
        by_length: dict[int, dict[bytes, float]] = {}
        for piece, log in zip(pieces, logs, strict=True):
            if piece:
                known = by_length.setdefault(len(piece), {})
                # a byte may be a piece twice, as a byte and as a character: both are ways to write it
                known[piece] = float(np.logaddexp(known[piece], log)) if piece in known else float(log)
        self.tables = {}
        for n, known in sorted(by_length.items()):
            texts = np.frombuffer(b"".join(p + bytes(8) for p in known), np.uint8).reshape(len(known), n + 8)
            key, first, last = (x[:, 0] for x in self._keys(texts, n))
            order = np.argsort(key)
            self.tables[n] = key[order], first[order], last[order], np.array(list(known.values()))[order]

    @staticmethod
    def _keys(texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of texts (8 bytes longer than they are) a key of the n bytes there, their first and last 8."""
        places = texts.shape[1] - 8 - n + 1
        words = np.ndarray((texts.shape[0], texts.shape[1] - 7), "<u8", texts, strides=(texts.shape[1], 1))
        if n < 8:
            first = words[:, :places] & np.uint64((1 << 8 * n) - 1)
            return first, first, first
        first, last = words[:, :places], words[:, n - 8 : n - 8 + places]
        key = first * _A
        for at in [*range(8, n - 8, 8), n - 8]:
            key = (key ^ (key >> np.uint64(31)) ^ words[:, at : at + places]) * _B
        return key, first, last

    def _arcs(self, texts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each piece length the log-probability of the piece that starts at each place, -inf where there is none."""
        size = texts.shape[1] - 8
        for n, (keys, firsts, lasts, logs) in self.tables.items():
            if n <= size:
                key, first, last = self._keys(texts, n)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found = (keys[at] == key) & (firsts[at] == first) & (lasts[at] == last)
                yield n, np.where(found, logs[at], -np.inf)

    def _equally_long(self, words: list[bytes]) -> np.ndarray:
        size = len(words[0])
        texts = np.frombuffer(b"".join(w + bytes(8) for w in words), np.uint8).reshape(len(words), size + 8)
        if len(words) < 8:  # one by one, along the pieces that there are
            return self._along(texts)
        arcs = dict(self._arcs(texts))
        forward = np.full((size + 1, len(words)), -np.inf)
        forward[0] = 0
        for end in range(1, size + 1):
            ways = [forward[end - n] + a[:, end - n] for n, a in arcs.items() if n <= end]
            best = np.max(ways, axis=0)
            level = np.where(np.isfinite(best), best, 0)
            with np.errstate(divide="ignore"):
                forward[end] = level + np.log(sum(np.exp(w - level) for w in ways))
        return forward[size]

    def _along(self, texts: np.ndarray) -> np.ndarray:
        """A few equally long words, in stretches of PIECE bytes: ways into the places of one stretch are held at a time."""
        size, reach = texts.shape[1] - 8, max(self.tables)
        ways: list[list[list[float]]] = [[[0.0]] + [[] for _ in range(reach)] for _ in texts]
        for at in range(0, size, PIECE):
            here = min(PIECE, size - at)
            stretch = np.zeros((len(texts), min(here + reach, size - at) + 8), np.uint8)
            stretch[:, :-8] = texts[:, at : at + stretch.shape[1] - 8]
            arcs = {n: a[:, :here] for n, a in self._arcs(stretch)}
            for k, into in enumerate(ways):
                into += [[] for _ in range(here)]
                out: list[list[tuple[int, float]]] = [[] for _ in range(here)]
                for n, logs in arcs.items():
                    for start in np.flatnonzero(np.isfinite(logs[k])).tolist():
                        out[start].append((n, float(logs[k, start])))
                for start in range(here):
                    forward = _log_sum(into[start])
                    into[start] = []
                    if forward > -math.inf:
                        for n, log in out[start]:
                            into[start + n].append(forward + log)
                del into[:here]
        return np.array([_log_sum(into[0]) for into in ways])

    def log10(self, words: list[bytes]) -> np.ndarray:
        marked = [START + w for w in words]
        out = np.empty(len(words))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(marked):
            by_size.setdefault(len(w), []).append(i)
        for size, rows in by_size.items():
            step = max(1, 200_000 // size)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                out[some] = self._equally_long([marked[i] for i in some])
        return out / math.log(10)


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their distinct words, with how often training texts have them."""
    for part in parts:
        training: Counter = Counter()
        other: set[bytes] = set()
        for text, held_out in zip(part.column("text").to_pylist(), part.column("held_out").to_pylist(), strict=True):
            words = text.lower().split()
            if held_out:
                other.update(words)
            else:
                training.update(words)
        unseen = [w for w in other if w not in training]
        for some, counts in ((list(training), list(training.values())), (unseen, [0] * len(unseen))):
            for at in range(0, len(some), 50_000):
                columns = [pa.array(some[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """texts: text (binary), held_out. Returns every distinct word and its count in training texts (0: only elsewhere)."""
    return texts.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _piece_counts(model: str):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        total = np.zeros(sp.vocab_size(), np.int64)
        for part in parts:
            cut = sp.encode([w.decode(errors="replace") for w in part.column("word").to_pylist()], num_threads=1)
            counts = part.column("n").to_numpy()
            ids = np.fromiter((i for c in cut for i in c), np.int64)
            np.add.at(total, ids, np.repeat(counts, [len(c) for c in cut]))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "n"])

    return batches


def piece_logs(words: DataFrame, ends: int, model: str) -> np.ndarray:
    """Natural log-probabilities of the pieces, and of the end mark last. One number a piece reaches the driver."""
    counts = prior_counts(model)
    known = words.where("n > 0").mapInArrow(_piece_counts(model), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    for row in known.collect():
        counts[row["piece"]] += row["n"]
    counts[-1] += ends
    pieces = [*vocabulary(model), b""]
    counts[[p is None for p in pieces]] = 0
    with np.errstate(divide="ignore"):
        return np.log(counts / counts.sum())


def _word_scores(model: str, held):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(model), held.value[:-1])
        for part in parts:
            score = pa.array(lattice.log10(part.column("word").to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns, score], ["word", "n", "score"])

    return batches


def _looked_up(held):
    """Texts (doc_id, text, held_out) to sums over their frequent words, and the list of their other words."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, row = held.value, TaskContext.get().partitionId() << 40
        for part in parts:
            out: list[tuple] = []
            for text in part.column("text").to_pylist():
                words = text.lower().split()
                found = [(head.get(w), w) for w in words]
                known = [f for f, _ in found if f]
                rest = [w for f, w in found if not f]
                out.append((row, len(words), sum(k[0] for k in known), sum(k[1] for k in known), math.fsum(k[2] for k in known), rest))
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.binary()))
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            names = ["row", "n_words", "base", "known", "score", "rest"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *made], ["doc_id", "held_out", *names])

    return batches


def _least_frequent(counted: DataFrame, head: int) -> int:
    """A count that at most `head` words reach: from a histogram over powers of two in sixteenths, a few hundred rows."""
    step = F.floor(F.log2("n") * 16).alias("step")
    sizes = counted.where("n > 0").groupBy(step).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()
    least, words = 1 << 62, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        words += row["words"]
        if words > head:
            break
        least = row["n"]
    return least


def lm_scores(docs: DataFrame, held_out, model: str, head: int = HEAD) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens (words and an end), n_known (seen in training), train_tokens, base_score
    (log10, add-one unigram over words), score (log10, all segmentations). Rows where held_out holds teach nothing."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    counted = stage(word_counts(texts.select("text", "held_out")), "words")
    ends = texts.where(~F.col("held_out")).count()
    sums = counted.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    logs = piece_logs(counted, ends, model)
    held = spark.sparkContext.broadcast(logs)  # one number a piece of the vocabulary
    scored = stage(counted.mapInArrow(_word_scores(model, held), "word binary, n long, score double"), "word-scores")
    frequent = scored.where(F.col("n") >= _least_frequent(counted, head)).collect()  # at most `head` words
    listed = spark.sparkContext.broadcast({bytes(r["word"]): (math.log10(r["n"] + 1), int(r["n"] > 0), r["score"]) for r in frequent})
    kind = "doc_id long, held_out boolean, row long, n_words long, base double, known long, score double, rest array<binary>"
    looked = stage(texts.mapInArrow(_looked_up(listed), kind), "looked-up")
    rest = (
        looked.select("row", F.explode("rest").alias("word")).join(scored, "word").groupBy("row")
        .agg(
            F.sum(F.log10(F.col("n") + 1)).alias("more_base"), F.count_if(F.col("n") > 0).alias("more_known"),
            F.sum("score").alias("more_score"),
        )
    )
    end_known, end_base, end_score = int(ends > 0), math.log10(ends + 1), float(logs[-1] / math.log(10))
    tokens = F.col("n_words") + 1
    more = lambda name: F.coalesce(name, F.lit(0))
    base = F.col("base") + more("more_base") + end_base - tokens * math.log10(total + distinct + 1)
    return looked.drop("rest").join(rest, "row", "left").select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + more("more_known") + end_known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + more("more_score") + end_score).alias("score"),
    )


ship(__name__)
