"""Language identification: scripts narrow the candidates, a Viterbi path over words labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.chars import LETTER, code_points, segments, tables

# First code points of the script ranges that are told apart, in order.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
STARTS = np.array([start for start, _ in SCRIPTS], np.uint32)
SCRIPT_OF_RANGE = np.array([NAMES.index(name) for _, name in SCRIPTS])

BUCKETS = 1 << 16  # of hashed trigrams: bounds the model for any corpus
SMOOTHING = 0.5
# A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
OUT_OF_SCRIPT = -50.0  # per word
SWITCH = 12.0  # what a change of language costs, in nats
UNDETERMINED = "und"
STEP = 4096  # words whose scores are plain numbers at once


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    grams: np.ndarray  # bucket of the trigram around each letter
    offset: np.ndarray  # first trigram of each word


def split_words(text: str | None) -> Iterator[Words]:
    """Runs of letters and marks, with a bucket for each letter and its neighbours in the word.

    A very long text comes in several parts.
    """
    for offset, codes in segments(code_points(text or "")):
        words = _split(codes)
        if len(words.start):
            yield words._replace(start=words.start + offset, end=words.end + offset)


def _split(codes: np.ndarray) -> Words:
    kind, lower, _ = tables()
    letter = (kind[codes] & LETTER) != 0
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    at = np.flatnonzero(letter)
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = np.where(letter, lower[codes], 0)
    mix = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)
    grams = (mix ^ (mix >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    lengths = end - start
    script = SCRIPT_OF_RANGE[np.searchsorted(STARTS, codes[start], "right") - 1]
    return Words(start, end, script, grams, np.cumsum(lengths) - lengths)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # by bucket and language
    allowed: np.ndarray  # by script and language: 0, or what a word of that script costs

    def spans(self, text: str | None) -> list[tuple[int, int, str, int]]:
        """Start, end, language and letters of each span; together they hold all words."""
        parts = list(self._scored(text)) if self.languages else []
        if not parts:
            return []
        start, end, scores = (np.concatenate(column) for column in zip(*parts, strict=True))
        path = best_path(scores)
        cuts = np.flatnonzero(np.diff(path, prepend=-1))
        letters = np.add.reduceat(end - start, cuts)
        last = np.append(cuts[1:], len(path)) - 1
        return [
            (int(start[a]), int(end[b]), self.languages[path[a]], int(n))
            for a, b, n in zip(cuts, last, letters, strict=True)
        ]

    def _scored(self, text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for words in split_words(text):
            fit = np.add.reduceat(self.logs[words.grams], words.offset, axis=0)
            yield words.start, words.end, fit + self.allowed[words.script]

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str, int]]]:
        """The language with most letters (ties: the first by name), its share of them, the spans."""
        # Marks alone, which words may hold, are no letters.
        spans = self.spans(text) if any(map(str.isalpha, text or "")) else []
        if not spans:
            return UNDETERMINED, 0.0, spans
        letters: dict[str, int] = {}
        for _, _, language, n in spans:
            letters[language] = letters.get(language, 0) + n
        best = min(letters, key=lambda name: (-letters[name], name))
        return best, letters[best] / sum(letters.values()), spans


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The labels of the words with the greatest sum of scores, less ``switch`` for each change.

    If no run of words gains more than half a change against the language that
    is best overall, that language labels every word: of a path with other
    languages in n runs, n changes or, if n > 1, n - 1 have to be paid.
    """
    count, languages = scores.shape
    top = int(scores.sum(axis=0, dtype=np.float64).argmax())
    gains = np.cumsum(scores - scores[:, top : top + 1], axis=0, dtype=np.float64)
    floor = np.minimum.accumulate(np.vstack([np.zeros((1, languages)), gains[:-1]]), axis=0)
    if (gains - floor).max() <= switch / 2:
        return np.full(count, top)
    # For each word but the first: the best label before it, and a bit for each label that a change
    # from that one improves. Plain numbers are quicker here than arrays of a few labels.
    before, changed = [], []
    value = scores[0].tolist()
    for start in range(1, count, STEP):
        for row in scores[start : start + STEP].tolist():
            most = max(value)
            change, flags = most - switch, 0
            before.append(value.index(most))
            if min(value) < change:
                flags = sum(1 << i for i, v in enumerate(value) if v < change)
                value = [(v if v >= change else change) + s for v, s in zip(value, row, strict=True)]
            else:
                value = [v + s for v, s in zip(value, row, strict=True)]
            changed.append(flags)
    path = np.empty(count, np.int64)
    path[-1] = label = value.index(max(value))
    for t in range(count - 2, -1, -1):
        if changed[t] >> label & 1:
            label = before[t]
        path[t] = label
    return path


def learn(docs: DataFrame) -> LanguageModel:
    """Learn from all rows of ``docs`` (lang, text) with a language and a text.

    Tasks count hashed trigrams and the scripts of letters; Spark adds up the
    counts. The model has at most 65,536 rows for any corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, part in batch.groupby("lang"):
                for words in (w for text in part["text"] for w in split_words(text)):
                    counts = totals.setdefault(language, np.zeros(BUCKETS + len(NAMES), np.int64))
                    np.add.at(counts, words.grams, 1)
                    np.add.at(counts, BUCKETS + words.script, words.end - words.start)
        for language, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": language, "at": at, "n": counts[at]})

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = known.mapInPandas(count, "lang string, at int, n long")
    rows = counted.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + len(NAMES), len(languages)))
    counts[rows["at"], [languages.index(name) for name in rows["lang"]]] = rows["n"]
    grams, letters = counts[:BUCKETS], counts[BUCKETS:]
    kinds = (grams.sum(axis=1) > 0).sum() + 1
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * kinds)).astype(np.float32)
    allowed = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    # A script that no language is written in leaves all of them as candidates.
    fits = np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0.0, OUT_OF_SCRIPT).astype(np.float32)
    return LanguageModel(languages, logs, fits)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and spans of each row of ``docs`` (doc_id, text).

    ``spans`` are character offsets with a language each. A null text, or one
    without letters, is ``und`` with score 0 and no spans, and so is any text
    if the model has learnt no language. Repeated rows are each given; other
    columns are left out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.predict(t if isinstance(t, str) else None) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "spans": [[{"start": a, "end": b, "lang": name} for a, b, name, _ in f[2]] for f in found],
                }
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    return docs.select("doc_id", "text").mapInPandas(predict, schema)


def clear_column(docs: DataFrame, text: Column, model: LanguageModel, least: float) -> Column:
    """Whether a text of ``docs`` has letters and one language holds at least the share ``least`` of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clear(texts: pd.Series) -> pd.Series:
        found = [shared.value.predict(t if isinstance(t, str) else None) for t in texts]
        return pd.Series([name != UNDETERMINED and share >= least for name, share, _ in found], dtype=bool)

    return clear(text)
