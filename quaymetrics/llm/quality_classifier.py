"""Compression classifier: a text is like the labelled texts whose dictionary compresses it better.

Two zstandard dictionaries are built, from good and from bad texts. A text's evidence is the difference of its compressed
sizes under the two, divided by its own size. Evidence becomes a score by logistic calibration on labelled rows that took
no part in the dictionaries, each class weighing as it is frequent.

The fit takes a bounded sample: of each class the `sample` labelled ids with the least hash, in whole texts, two thirds
for the dictionary and the rest for the calibration. Every row of the table to score is scored, whole.

Defined cases: null counts as empty; an empty text has evidence 0; labels that are null, rows without a text and repeated
labels of one doc_id (of which the least counts) don't disturb; where a class has too few labelled texts for a dictionary,
every score is the share of label 1 (0.5 if there are no labels). Rows equal in all columns are rows of their own; other columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.common import ship

SAMPLE = 1500
#: Texts of a class below which no dictionary can be built.
LEAST = 10
#: Share of the sample that builds dictionaries.
FOR_DICTIONARY = 2 / 3
DICTIONARY_BYTES = 112_640
#: Length of the segments that a dictionary takes from texts, and of the strings by which it rates them.
SEGMENT, GRAM = 512, 8
LEVEL = 3


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float

    def scorer(self):
        """A function from texts to scores."""
        if not self.good or not self.bad:
            return lambda texts: np.full(len(texts), self.prior)
        sizes = _sizer(self.good, self.bad)
        return lambda texts: _logistic(_features(sizes, texts) @ np.array(self.weights))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _sizer(good: bytes, bad: bytes):
    """Sizes of a text compressed with the dictionary of good texts, and with that of bad ones."""
    both = []
    for data in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False))
    return lambda text: [len(c.compress(text)) for c in both]


def _dictionary(texts: list[bytes]) -> bytes:
    return zstandard.train_dictionary(DICTIONARY_BYTES, texts, k=SEGMENT, d=GRAM).as_bytes()


def _features(sizes, texts: list[bytes]) -> np.ndarray:
    """Rows of 1 and the normalised difference of the compressed sizes."""
    out = np.ones((len(texts), 2))
    for i, text in enumerate(texts):
        good, bad = sizes(text) if text else (0, 0)
        out[i, 1] = (bad - good) / max(len(text), 1)
    return out


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps with a little ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _logistic(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CompressionModel:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1). At most `sample` texts of each class reach the driver."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    # ids are chosen first, so that only the sample's texts travel
    order = F.xxhash64("doc_id")
    chosen = F.broadcast(
        marked.where("quality = 0").orderBy(order, "doc_id").limit(sample)
        .unionByName(marked.where("quality = 1").orderBy(order, "doc_id").limit(sample))
    )
    texts = docs.where(F.octet_length("text") > 0).select("doc_id", "text", order.alias("h")).join(chosen, "doc_id")
    by_class: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(texts.collect(), key=lambda r: (r["h"], r["text"])):
        by_class[row["quality"]].append(row["text"].encode())
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.5
    cut = {q: int(len(t) * FOR_DICTIONARY) for q, t in by_class.items()}
    if min(len(t) - cut[q] for q, t in by_class.items()) < 1 or min(cut.values()) < LEAST:
        return CompressionModel(b"", b"", (), prior)
    good, bad = (_dictionary(by_class[q][: cut[q]]) for q in (1, 0))
    rest = {q: t[cut[q] :] for q, t in by_class.items()}
    x = np.concatenate([_features(_sizer(good, bad), rest[q]) for q in (1, 0)])
    y = np.repeat([1.0, 0.0], [len(rest[1]), len(rest[0])])
    weight = np.where(y == 1, counts[1] / len(rest[1]), counts[0] / len(rest[0])) / n * len(y)
    return CompressionModel(good, bad, tuple(_calibrated(x, y, weight)), prior)


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """Per row: doc_id, score (0 to 1, likelihood of label 1), predicted (1 from a score of 0.5)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = held.value.scorer()
        for part in parts:
            found = scores([bytes(t) if t is not None else b"" for t in part["text"]])
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": found, "predicted": (found >= 0.5).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(batches, "doc_id long, score double, predicted int")


def remainder(doc_id: str, by: int):
    """crc32 of the doc_id as text, modulo by; null for null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def quality_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on labels of two thirds of the ids, score all: doc_id, held_out, score, predicted."""
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = fit(docs, labels.where(~held_out), sample)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


ship(__name__)
