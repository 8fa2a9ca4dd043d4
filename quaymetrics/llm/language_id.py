"""Language ID: scripts narrow the candidates, a Viterbi path over word scores labels spans, the spans name the text.

Each language has log-probabilities of hashed byte n-grams (3 and 4 bytes long, word edges included), and the scripts that
its training words are written in. A word is scored for the languages that use its script; where none does, for all. The
best path over the words of a text pays `SWITCH` whenever it changes language, so that single odd words don't. Equal
neighbours on the path form a span. A text's language is that of the spans with the most letters; its score is their
share of the letters of all spans.

Training takes a bounded sample: for each language about `PER_LANGUAGE` rows, those with the least hash of doc_id, in
whole texts. Every language that has a training row is learned, however rare; the model takes 256 KB a language, and all tasks
hold it. Every row is labelled, whole.

Defined cases: null texts, and texts without any letter, are `und` with score 0 and no spans (digits, number forms such as
`½` and `Ⅷ`, and combining marks are no letters); where nothing was learned all
texts are `und`; words without letters join the span that they stand in; of equal shares the smaller name wins; a
null doc_id never trains; rows equal in all columns are rows of their own; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.common import ship

UND = "und"
PER_LANGUAGE = 3000
#: Natural-log cost of a change of language between two words.
SWITCH = 6.0
BUCKET_BITS = 16
SMOOTHING = 0.1
#: A language uses a script that at least this share of its training letters is in.
SCRIPT_SHARE = 0.02
#: Characters of text that are scored at once, for up to eight languages; fewer for more.
CHUNK = 1 << 21
#: Languages that a training task counts before it hands their counts on.
COUNTED = 64

#: Scripts by ranges of code points (first, last); letters in no range are script 0.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
_RANGES = sorted((lo, hi, k) for k, spans in enumerate(SCRIPTS.values(), 1) for lo, hi in spans)
_EDGES = np.array([x for lo, hi, _ in _RANGES for x in (lo, hi + 1)])
_KINDS = np.array([0] + [x for _, _, k in _RANGES for x in (k, 0)])
_ASCII_LETTER = re.compile("[A-Za-z]")
_MUL = np.uint32(0x9E3779B1)


@dataclass
class LanguageModel:
    names: list[str]
    logs: np.ndarray  # languages x buckets
    scripts: np.ndarray  # languages x scripts, whether used


def _scripts(points: np.ndarray) -> np.ndarray:
    return _KINDS[np.searchsorted(_EDGES, points, "right")]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: the joined bytes with one space around each word, the text that each word is from, and its letters
    by script."""
    split = [t.split() for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    flat = [w for s in split for w in s]
    joined = " " + " ".join(flat) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    word_of = np.cumsum(points == 0x20) - 1  # 0 for the first word; spaces belong to the word after them
    kinds = np.zeros(len(points), np.int64)
    letters = np.zeros(len(points), bool)
    ascii_ = points < 128
    letters[ascii_] = ((points[ascii_] | 32) >= 97) & ((points[ascii_] | 32) <= 122)
    rest = np.flatnonzero(~ascii_)
    letters[rest] = [chr(c).isalpha() for c in points[rest].tolist()] if len(rest) < 64 else _alpha(points[rest])
    kinds[letters] = _scripts(points[letters])
    n = len(SCRIPTS) + 1
    counts = np.bincount(word_of[letters] * n + kinds[letters], minlength=len(flat) * n)[: len(flat) * n].reshape(len(flat), n)
    return np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8), owner, counts


def _alpha(points: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(points, return_inverse=True)
    return np.array([chr(c).isalpha() for c in distinct.tolist()])[back]


def _has_letter(text: str) -> bool:
    """As letters are counted in _words()."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, set(text)))


def _buckets(data: np.ndarray) -> list[np.ndarray]:
    """Hashed 3-grams and 4-grams at each byte, A-Z lower-cased; grams do not reach beyond the data."""
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    three = lowered[:-2] | lowered[1:-1] << 8 | lowered[2:] << 16
    four = three[:-1] | lowered[3:] << 24
    shift = np.uint32(32 - BUCKET_BITS)
    return [(three * _MUL) >> shift, ((four ^ np.uint32(0x5BD1E995)) * _MUL) >> shift]


def _grams_in_words(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each gram length: buckets, and the words that they start in. Grams that cross from word to word are left out."""
    space = data == 0x20
    word = np.cumsum(space) - 1
    out = []
    for size, buckets in zip((3, 4), _buckets(data), strict=True):
        n = len(buckets)
        # a gram may begin or end with a space, but not hold one inside
        inside = ~np.logical_or.reduce([space[k : n + k] for k in range(1, size - 1)])
        out.append((buckets[inside], word[:n][inside]))
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """docs: doc_id, text, lang. Gram counts are added up by Spark; languages x buckets numbers reach the driver."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    names = sorted(r["lang"] for r in sizes)
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in sizes}
    n_scripts = len(SCRIPTS) + 1
    if not names:
        return LanguageModel([], np.zeros((0, 1 << BUCKET_BITS), np.float32), np.zeros((0, n_scripts), bool))
    # the sample is spread evenly over hashes of doc_id: those below a language's share
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    limits = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    sample = known.where(place < limits[F.col("lang")]).select("lang", "text")

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(names)}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, tables in held.items():
                for kind, table in enumerate(tables):
                    at = np.flatnonzero(table)
                    columns = [np.full(len(at), kind, np.int32), np.full(len(at), number[lang], np.int32), at.astype(np.int32), table[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "lang", "at", "n"])
            held.clear()

        for part in parts:
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if lang not in held:
                    if len(held) == COUNTED:
                        yield from handed_on()
                    held[lang] = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(n_scripts, np.int64)
                grams, scripts = held[lang]
                data, _, counts = _words([text])
                scripts += counts.sum(axis=0)
                for buckets, _ in _grams_in_words(data):
                    grams += np.bincount(buckets, minlength=1 << BUCKET_BITS)
        yield from handed_on()

    sums = sample.mapInArrow(counted, "kind int, lang int, at int, n long").groupBy("kind", "lang", "at").agg(F.sum("n").alias("n")).toPandas()
    tables = [np.zeros((len(names), 1 << BUCKET_BITS)), np.zeros((len(names), n_scripts))]
    for kind, table in enumerate(tables):
        own = sums[sums["kind"] == kind]
        table[own["lang"], own["at"]] = own["n"]
    grams, scripts = tables
    smooth = grams + SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
    return LanguageModel(names, logs, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1))


def _word_scores(model: LanguageModel, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """words x languages; languages that don't use a word's script are out, unless all would be."""
    n, languages = len(counts), len(model.names)
    scores = np.zeros((n, languages), np.float32)
    for buckets, word in _grams_in_words(data):
        for k in range(languages):
            scores[:, k] += np.bincount(word, model.logs[k][buckets], n)[:n]
    lettered = counts.sum(axis=1) > 0
    fits = model.scripts.T[counts.argmax(axis=1)]  # words x languages
    out = lettered[:, None] & ~fits & fits.any(axis=1)[:, None]
    scores[out] = -np.inf
    scores[~lettered] = 0
    return scores


def viterbi(scores: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The best language of each word, over all texts at once, word place by word place. owner: each word's text, sorted."""
    sizes = np.bincount(owner, minlength=texts)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    by_size = np.argsort(-sizes, kind="stable")
    by_size = by_size[sizes[by_size] > 0]
    came = np.zeros(scores.shape, np.int16)
    languages = np.arange(scores.shape[1], dtype=np.int16)
    best = scores[first[by_size]].astype(np.float64)
    label = np.zeros(len(owner), np.int16)
    longest = int(sizes.max()) if texts else 0
    live = len(by_size)
    ends = {}
    falling = sizes[by_size]
    for step in range(1, longest + 1):
        still = int(np.searchsorted(-falling, -step, "left"))  # texts with more than `step` words
        if still < live:
            ends[step] = (still, live)
            label[first[by_size[still:live]] + step - 1] = best[still:live].argmax(axis=1)
            live = still
            best = best[:live]
        if step == longest or not live:
            break
        at = first[by_size[:live]] + step
        top = best.argmax(axis=1)
        changed = best[np.arange(live), top] - SWITCH
        switch = changed[:, None] > best
        came[at] = np.where(switch, top[:, None], languages)
        best = np.where(switch, changed[:, None], best) + scores[at]
    # back along the arrows, longest texts first to join
    state = np.zeros(len(by_size), np.int16)
    for step in range(longest - 1, -1, -1):
        n = int(np.searchsorted(-falling, -step, "left"))  # texts that have a word at this place
        at = first[by_size[:n]] + step
        if step + 1 in ends:
            lo, hi = ends[step + 1]
            state[lo:hi] = label[at[lo:hi]]
        label[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return label


def label_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans (lang, first word, words) of each text."""
    langs, shares, spans = [UND] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    rows = [i for i, t in enumerate(texts) if t and _has_letter(t)] if model.names else []
    held, size, most = [], 0, CHUNK * 8 // max(8, len(model.names))
    for k, i in enumerate(rows):
        held.append(i)
        size += len(texts[i])
        if size < most and k < len(rows) - 1:
            continue
        data, owner, counts = _words([texts[j] for j in held])
        label = viterbi(_word_scores(model, data, counts), owner, len(held))
        letters = counts.sum(axis=1)
        n = len(model.names)
        share = np.bincount(owner * n + label, letters, len(held) * n).reshape(len(held), n)
        best = share.argmax(axis=1)
        start = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(held)))[:-1]))
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])))
        for at, end in zip(new.tolist(), [*new[1:].tolist(), len(owner)], strict=True):
            text = int(owner[at])
            spans[held[text]].append({"lang": model.names[label[at]], "first": at - int(start[text]), "words": end - at})
        for j, text in enumerate(held):
            langs[text] = model.names[best[j]]
            shares[text] = float(share[j, best[j]] / max(share[j].sum(), 1))
        held, size = [], 0
    return langs, shares, spans


def label_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and spans, in place of columns of those names."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers
    kind = "lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))
        for part in parts:
            langs, shares, spans = label_texts(held.value, part.column("text").to_pylist())
            made = [pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "lang_pred", "score", "spans"])

    kept = docs.drop("lang_pred", "score", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(batches, f"{schema}, {kind}")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the doc_id as text, modulo by; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from two thirds of the ids, label all: doc_id, held_out, lang_pred, score."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return label_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a language, with at least this score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs, shares, _ = label_texts(held.value, part.column("text").to_pylist())
            yield part.filter(pa.array([n != UND and s >= least for n, s in zip(langs, shares, strict=True)], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


ship(__name__)
