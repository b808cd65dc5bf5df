"""Toxicity: a support vector machine with a subsequence string kernel, by Nyström landmarks.

Texts are split into sentences, and sentences into units: words without their
symbols, runs of words of one or two letters taken as one ("i d i o t"), and
windows of long words. Two units are alike by the subsequences of three letters
that they share, each discounted by ``DECAY`` for every letter it spans, so letters
between those of an insult lower the likeness but do not end it. Such subsequences
can be numbered, hence landmarks are kept as rows over these numbers, and what the
machine makes of all landmarks folds into one weight per subsequence.

A sentence scores as its worst unit does. What a document's sentences reach, how
many are over zero and which share, becomes a probability by a logistic regression.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.chars import LETTER, SPACE, code_points, segments, tables
from docloom.session import cut_lineage

SPAN = 7  # letters that a subsequence reaches over at most
DECAY = 0.75
BITS = 6  # of a letter's class
BEGIN, SYMBOL, BLANK = 61, 62, 63  # classes that are no letters: a mark before each unit, all else, white space
UNIT, STRIDE = 24, 12  # letters of a window of a long unit, and from one to the next
SHORT = 2  # letters of words that are joined
CHUNK = 1 << 18  # characters worked on at a time
SLAB = 512  # units compared with landmarks at a time
STOPS = tuple(ord(c) for c in ".!?")
NEWLINE = 10

# Bounds of the fit: labelled texts that are learnt from, landmarks, units of either label.
TEXTS = 12_000
LANDMARKS = 384
MARKED = 4_000
PLAIN = 16_000
# A unit marks toxic texts if it is so many times more frequent there, and beyond chance (G² of 15 is 1 in 10,000).
TIMES = 4.0
EVIDENCE = 15.0
RIDGE = 1e-5
VARIANTS = 2.0  # weight of a unit's disturbed forms, as a share of its own
SURE = 0.8  # score of a sentence that is toxic nearly always
STATISTICS = ["one", "most", "over", "sure", "share"]


# --- units -----------------------------------------------------------------------------


@cache
def classes() -> np.ndarray:
    """Class of each code point: letters without their accents, others folded into the classes after z."""
    kind, lower, _ = tables()
    out = np.full(len(kind), SYMBOL, np.uint8)
    out[(kind & SPACE) != 0] = BLANK
    for code in np.flatnonzero(kind & LETTER).tolist():
        base = unicodedata.normalize("NFD", chr(int(lower[code])))[0]
        out[code] = ord(base) - 97 if "a" <= base <= "z" else 26 + ord(base) % (BEGIN - 26)
    return out


@dataclass(frozen=True)
class Units:
    """Units of a chunk: ``letters`` (classes), and of each unit its first letter, end and sentence; the text of each sentence."""

    letters: np.ndarray
    room: np.ndarray  # letters from each letter to the end of its word
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    text_of: np.ndarray


def units(codes: np.ndarray, text_ends: np.ndarray) -> Units:
    """Units of the texts that end at ``text_ends`` of ``codes``."""
    kind = classes()[codes]
    blank = kind == BLANK
    # A sentence ends at a line's end, at a stop before white space, and with its text.
    stop = codes == NEWLINE
    after = np.ones(len(codes), bool)
    after[:-1] = blank[1:]
    for code in STOPS:
        stop |= (codes == code) & after
    last = np.zeros(len(codes) + 1, bool)
    last[text_ends[text_ends > 0] - 1] = True
    stop |= last[:-1]
    sentence = np.cumsum(stop) - stop
    # A word goes on to the next white space or the end of its text.
    word = np.cumsum(blank | np.concatenate([[False], last[: len(codes) - 1]]))
    at = np.flatnonzero(kind < SYMBOL)
    empty = np.zeros(0, np.int64)
    if not len(at):
        return Units(empty.astype(np.uint8), empty, empty, empty, empty, empty)
    letters, word, owner = kind[at], word[at], sentence[at]
    first = np.concatenate([[True], word[1:] != word[:-1]])
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(at))
    # Neighbouring short words of one sentence are one unit.
    short = end - start <= SHORT
    joined = np.zeros(len(start), bool)
    joined[1:] = short[1:] & short[:-1] & (owner[start[1:]] == owner[start[:-1]])
    start = start[~joined]
    end = np.append(start[1:], len(at))
    owner = owner[start]
    letters = np.insert(letters, start, BEGIN)
    start, end = start + np.arange(len(start)), end + np.arange(1, len(start) + 1)
    room = np.repeat(end, end - start) - np.arange(len(letters))
    # Long units are windows; the last one ends with the unit.
    length = end - start
    windows = np.maximum(1, -((STRIDE - length) // STRIDE))
    windows[length <= UNIT] = 1
    base = np.repeat(start, windows)
    number = np.arange(len(base)) - np.repeat(np.cumsum(windows) - windows, windows)
    limit = np.repeat(end, windows)
    single = np.repeat(windows == 1, windows)
    begin = base + number * STRIDE
    finish = np.where(single, limit, np.minimum(begin + UNIT, limit))
    text_of = np.searchsorted(text_ends, np.flatnonzero(stop), side="right")
    return Units(letters, room, begin, finish, np.repeat(owner, windows), text_of)


def chunks(texts: Iterator[str | None] | pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of several texts, or of a part of a very long one; the ends of the texts, and their numbers."""
    parts, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        for _, part in segments(code_points(text if isinstance(text, str) else "")):
            if not len(part):
                continue
            parts.append(part)
            numbers.append(number)
            size += len(part)
            if size >= CHUNK:
                yield np.concatenate(parts), np.cumsum([len(p) for p in parts]), np.array(numbers)
                parts, numbers, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.cumsum([len(p) for p in parts]), np.array(numbers)


def pairs() -> list[tuple[int, int]]:
    return [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]


@cache
def norms() -> np.ndarray:
    """Length of a unit of n letters in the space of subsequences, if all of these differ."""
    own = [sum(DECAY ** (2 * (k + 1)) * max(0, n - k) for _, k in pairs()) for n in range(UNIT + 1)]
    return np.sqrt(own)


def unit_norms(length: np.ndarray) -> np.ndarray:
    return np.maximum(norms()[np.minimum(length, UNIT)], 1e-9)


def reached(u: Units, weights: np.ndarray) -> np.ndarray:
    """For each unit the sum over its subsequences of their weight, discounted, over the unit's norm."""
    count = len(u.letters)
    padded = np.concatenate([u.letters, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    head, total = padded[:count] << (2 * BITS), np.zeros(count, np.float32)
    inside = {k: (u.room > k).astype(np.float32) * np.float32(DECAY ** (k + 1)) for k in range(2, SPAN)}
    for j in range(1, SPAN - 1):
        two = head + (padded[j : j + count] << BITS)
        for k in range(j + 1, SPAN):
            total += weights[two + padded[k : k + count]] * inside[k]
    sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
    return (sums[u.end] - sums[u.start]) / unit_norms(u.end - u.start)


def spell(u: Units) -> list[bytes]:
    """The letters of each unit, a byte a class."""
    whole = u.letters.tobytes()
    return [whole[a:b] for a, b in zip(u.start.tolist(), u.end.tolist(), strict=True)]


# --- model -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Toxicity:
    """Weight of each subsequence, the machine's offset, and the regression over what sentences reach."""

    weights: np.ndarray
    offset: float
    logistic: np.ndarray

    def scores(self, texts: pd.Series) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.statistics(texts) @ self.logistic, -30, 30)))

    def statistics(self, texts: pd.Series) -> np.ndarray:
        """One, the highest score of a sentence, log(1 + sentences over zero, and over SURE), the share of the
        former, of each text."""
        most = np.full(len(texts), min(self.offset, 0.0))
        over, sure, total = np.zeros((3, len(texts)))
        if len(self.weights):
            for codes, ends, numbers in chunks(texts):
                u = units(codes, ends)
                if not len(u.start):
                    continue
                first = np.flatnonzero(np.concatenate([[True], u.sentence[1:] != u.sentence[:-1]]))
                worst = np.maximum.reduceat(reached(u, self.weights), first) + self.offset
                owner = numbers[u.text_of[u.sentence[first]]]
                np.maximum.at(most, owner, worst)
                total += np.bincount(owner, minlength=len(texts))
                over += np.bincount(owner, weights=worst > 0, minlength=len(texts))
                sure += np.bincount(owner, weights=worst > SURE, minlength=len(texts))
        return np.column_stack([np.ones(len(texts)), np.clip(most, -1, 1), np.log1p(over), np.log1p(sure), over / (total + 1)])

    def column(self, text: Column) -> Column:
        @F.pandas_udf("double")
        def of_texts(texts: pd.Series) -> pd.Series:
            return pd.Series(self.scores(texts), dtype=float)

        return of_texts(text)


def constant(share: float) -> Toxicity:
    odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return Toxicity(np.zeros(0, np.float32), 0.0, np.array([odds, 0.0, 0.0, 0.0, 0.0]))


# --- fit -------------------------------------------------------------------------------


def subsequences(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row, number of the subsequence, and its discounted share, of all subsequences of units."""
    lengths = np.array([len(r) for r in rows], np.int64)
    letters = np.frombuffer(b"".join(rows), np.uint8).astype(np.int32)
    row = np.repeat(np.arange(len(rows)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))
    found = []
    for j, k in pairs():
        p = np.flatnonzero(room > k)
        code = (letters[p] << (2 * BITS)) + (letters[p + j] << BITS) + letters[p + k]
        found.append((row[p], code, DECAY ** (k + 1) / unit_norms(lengths[row[p]])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Landmarks:
    """Units that others are compared with, as rows over the subsequences that they hold."""

    def __init__(self, rows: list[bytes]):
        row, code, share = subsequences(rows)
        self.codes, column = np.unique(code, return_inverse=True)
        self.matrix = np.zeros((len(self.codes), len(rows)), np.float32)
        np.add.at(self.matrix, (column, row), share)
        # Nyström: landmarks' likenesses among themselves, whitened.
        values, vectors = np.linalg.eigh((self.matrix.T @ self.matrix).astype(float))
        kept = values > 1e-6 * values.max()
        self.whiten = vectors[:, kept] / np.sqrt(values[kept])

    def kernel(self, rows: list[bytes]) -> np.ndarray:
        """Likeness of each unit to each landmark."""
        out = np.zeros((len(rows), self.matrix.shape[1]))
        for at in range(0, len(rows), SLAB):
            row, code, share = subsequences(rows[at : at + SLAB])
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[place] == code
            order = np.argsort(row[known], kind="stable")
            row, place, share = row[known][order], place[known][order], share[known][order]
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[at + row[first]] = np.add.reduceat(self.matrix[place] * share[:, None].astype(np.float32), first, axis=0)
        return out

    def features(self, rows: list[bytes]) -> np.ndarray:
        return self.kernel(rows) @ self.whiten

    def fold(self, beta: np.ndarray) -> np.ndarray:
        """A weight per subsequence that gives what ``beta`` gives over the features."""
        weights = np.zeros(1 << (3 * BITS), np.float32)
        weights[self.codes] = self.matrix @ (self.whiten @ beta)
        return weights


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last number is the offset."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] *= 1e-3
    loss = lambda b: (ridge * b * b).sum() + (weight * np.maximum(0, 1 - y * (x @ b)) ** 2).sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ beta) < 1
        own = x[active] * weight[active, None]
        wanted = np.linalg.solve(own.T @ x[active] + np.diag(ridge), own.T @ y[active])
        size = 1.0
        while size > 1e-3 and loss(beta + size * (wanted - beta)) > loss(beta):
            size /= 2
        if np.abs(size * (wanted - beta)).max() < 1e-6:
            break
        beta = beta + size * (wanted - beta)
    return beta


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    beta, ridge = np.zeros(x.shape[1]), np.append(1e-6, np.full(x.shape[1] - 1, 0.1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def disturbed(rows: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Units with a letter put in at each place, with two, and with one at every place; and which unit each is of.

    The letters are taken in turn, so they are of every kind over all units.
    """
    out, whose, letter = [], [], 0
    for number, row in enumerate(rows):
        if len(row) < 5:
            continue
        for at in range(2, len(row)):
            letter = (letter + 7) % 26
            once = row[:at] + bytes([letter]) + row[at:]
            other = len(once) - at + 1
            out += [once, once[:other] + bytes([(letter + 11) % 26]) + once[other:]]
            whose += [number, number]
        out.append(row[:2] + b"".join(bytes([letter, c]) for c in row[2:]))
        whose.append(number)
    return out, np.array(whose, np.int64)


def evidence(pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """G² of each unit's texts against the labels; 0 unless it is ``TIMES`` as frequent in toxic texts."""
    out = np.zeros(len(pos))
    share = (pos + neg) / (toxic + clean)
    for seen, of in ((pos, toxic), (neg, clean)):
        for count, chance in ((seen, share), (of - seen, 1 - share)):
            wanted = of * chance
            out += 2 * np.where(count > 0, count * np.log(np.maximum(count, 1e-9) / np.maximum(wanted, 1e-9)), 0)
    more = (pos + 0.5) / (toxic + 1) > TIMES * (neg + 0.5) / (clean + 1)
    return np.where(more, out, 0)


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, _hash) of at most ``most`` different texts that have a label, chosen by the hash of the text.

    Only ids and hashes are joined to the labels; texts follow for those chosen.
    A text with several labels, its copies' included, takes what most of them say.
    """
    hashed = F.xxhash64("text").alias("_hash")
    marks = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    named = docs.where(F.col("text").isNotNull()).select("doc_id", hashed)
    per_text = named.join(marks, "doc_id").groupBy("_hash").agg(F.avg("toxic").alias("toxic"), F.min("doc_id").alias("_id"))
    chosen = cut_lineage(per_text.orderBy(F.xxhash64("_hash", F.lit(12)), "_hash").limit(most))
    # At most ``most`` rows of three numbers.
    small = F.broadcast(chosen.withColumnRenamed("_id", "doc_id"))
    texts = docs.select("doc_id", "text", hashed).join(small, ["doc_id", "_hash"])
    one = texts.groupBy("_hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return one.select("text", (F.col("toxic") >= 0.5).cast("int").alias("toxic"), "_hash")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(unit, label, texts, sentences): in how many texts and sentences of a label each unit is."""
    for batch in batches:
        texts, sentences = Counter(), Counter()
        labels = batch["toxic"].to_numpy()
        seen = set()
        for codes, ends, numbers in chunks(batch["text"]):
            u = units(codes, ends)
            owner = u.text_of[u.sentence] if len(u.start) else u.sentence
            for unit, place, sentence in set(zip(spell(u), owner.tolist(), u.sentence.tolist(), strict=True)):
                number = int(numbers[place])
                sentences[unit, int(labels[number])] += 1
                if (unit, number) not in seen:
                    seen.add((unit, number))
                    texts[unit, int(labels[number])] += 1
        rows = [(unit, label, texts[unit, label], n) for (unit, label), n in sentences.items() if len(unit) > 3]
        yield pd.DataFrame(rows, columns=["unit", "label", "texts", "sentences"])


def fit(docs: DataFrame, labels: DataFrame, most: int = TEXTS) -> Toxicity:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); labels other than 0 and 1 are left out.

    A sentence has the label of its text. In toxic texts not every sentence is, so
    a toxic sentence stands for its most evident unit, and has none if no unit of
    it marks toxic texts; all units of clean sentences are clean. The machine is
    fitted, then once more with what it finds toxic in toxic texts only. The
    regression is fitted on a third of the texts, which the machine has not seen.
    With one label only, or no unit that marks toxic texts, scores are the share
    of toxic texts; without labels, zero.
    """
    texts = cut_lineage(sample(docs, labels, most).repartition(docs.sparkSession.sparkContext.defaultParallelism))
    kept_back = F.pmod(F.xxhash64("_hash", F.lit(3)), F.lit(3)) == 0
    shown = texts.where(~kept_back)
    sums = {r["toxic"]: r["n"] for r in shown.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sums.get(1, 0), sums.get(0, 0)
    if not toxic or not clean:
        return constant(toxic / (toxic + clean) if toxic + clean else 0.0)
    counted = shown.select("text", "toxic").mapInPandas(_counted, "unit binary, label int, texts long, sentences long")
    of = lambda label, name: F.sum(F.when(F.col("label") == label, F.col(name)).otherwise(0))
    table = cut_lineage(
        counted.groupBy("unit").agg(
            of(1, "texts").alias("pos"), of(0, "texts").alias("neg"),
            of(1, "sentences").alias("pos_sentences"), of(0, "sentences").alias("neg_sentences"),
        )
    )
    # Bounded: units most out of proportion, the most frequent clean ones, and a sample of the rest.
    lean = F.col("pos") * F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5) * F.lit(clean / toxic))
    mixed = F.xxhash64("unit", F.lit(5))
    drawn = [
        table.where("pos > 1").orderBy(lean.desc(), "unit").limit(MARKED),
        table.where("neg > 0").orderBy(F.col("neg").desc(), "unit").limit(PLAIN // 4),
        table.where("neg > 0").orderBy(mixed, "unit").limit(PLAIN),
        table.where("neg = 0").orderBy(mixed, "unit").limit(PLAIN // 2),
    ]
    # A unit of the sample of clean ones stands for as many as there are to one that was drawn.
    stands_for = max(1.0, table.where("neg > 0").count() / PLAIN)
    found = pd.concat([d.toPandas().assign(drawn=i) for i, d in enumerate(drawn)]).drop_duplicates("unit").reset_index(drop=True)
    rows = [bytes(u) for u in found["unit"]]
    pos, neg = found["pos"].to_numpy(float), found["neg"].to_numpy(float)
    proof = evidence(pos, neg, toxic, clean)
    marked = np.flatnonzero(proof > EVIDENCE)
    if not len(marked):
        return constant(toxic / (toxic + clean))
    tops = marked[np.argsort(-proof[marked], kind="stable")][: LANDMARKS * 3 // 4]
    plain = np.setdiff1d(np.flatnonzero(neg > 0), marked)
    usual = plain[np.argsort(-neg[plain], kind="stable")][: LANDMARKS - len(tops)]
    landmarks = Landmarks([rows[i] for i in [*tops, *usual]])
    x = landmarks.features(rows)
    odd, whose = disturbed([rows[i] for i in tops])
    odd_x = landmarks.features(odd)
    odd_weight = VARIANTS * (found["pos_sentences"].to_numpy(float)[tops] / np.bincount(whose, minlength=len(tops)))[whose]
    bad = np.isin(np.arange(len(rows)), marked)
    beta = np.zeros(x.shape[1] + 1)
    sentences = found[["pos_sentences", "neg_sentences"]].to_numpy(float)
    alone = found["drawn"].to_numpy() == 2
    weights = (sentences[:, 0], sentences[:, 1] * np.where(alone, stands_for, 1.0))
    for _ in range(2):
        # Toxic sentences stand for marked units, clean ones for all of theirs, marked ones too: the squared
        # hinge then takes a unit to where its sentences are, not to one side.
        toxic_rows, clean_rows = np.flatnonzero(bad), np.flatnonzero(neg > 0)
        y = np.repeat([1.0, 1.0, -1.0], [len(toxic_rows), len(odd), len(clean_rows)])
        weight = np.concatenate([weights[0][toxic_rows], odd_weight, weights[1][clean_rows]])
        beta = machine(np.concatenate([x[toxic_rows], odd_x, x[clean_rows]]), y, weight / weights[0][toxic_rows].sum())
        bad = bad | ((x @ beta[:-1] + beta[-1] > 0) & (neg == 0))
    model = Toxicity(landmarks.fold(beta[:-1]), float(beta[-1]), np.zeros(5))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = pd.DataFrame(model.statistics(batch["text"]), columns=STATISTICS)
            yield got.assign(toxic=batch["toxic"].to_numpy())

    held = texts.where(kept_back).select("text", "toxic")
    seen = held.mapInPandas(reach, ", ".join(f"{n} double" for n in STATISTICS) + ", toxic int").toPandas()
    if seen["toxic"].nunique() < 2:
        return constant(toxic / (toxic + clean))
    beta = logistic(seen[STATISTICS].to_numpy(), seen["toxic"].to_numpy(float))
    return Toxicity(model.weights, model.offset, beta)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text).

    Null and empty texts, and those without letters, have no sentence that says
    anything, and score as such a text does. Very long texts are worked on in
    parts of a million characters, all of them. Repeated rows score alike.
    More columns are not read.
    """
    return docs.select("doc_id", model.column(F.col("text")).alias("score"))
