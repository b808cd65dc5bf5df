"""Language-model scores: cross-entropy of a target model less that of a background model.

The models count all words and all pairs of words. Words are a table; a pair's
counts are never stored, as most pairs stand in one text alone: each text's
pairs are dealt out by the pair, where they are counted and weighed at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import bloom
from docloom.llm.chars import code_points, tokens
from docloom.session import shared_dir

# The word that stands for both ends of a text.
END = np.int64(0x5851F42D4C957F2D)
# Weight of the unigram model in a word's followers, in counts.
BACK_OFF = 50.0
# Words, or pairs, that a task holds before it hands them on.
HELD = 1 << 19
# Pairs that are weighed at once.
WEIGHED = 1 << 17
# Pairs are dealt to buckets, and what they add to parts of the texts, of about so many words each. The fewer
# the buckets, the more pairs of a text meet in one, and the fewer the rows, of which each bucket has one for a part.
BUCKET, LEAST = 1 << 20, 512
PART = 1 << 21
# Words and pairs whose counts are brought to every task: the most frequent ones, each at most this
# many rows of three numbers. So no other pair is a hot key.
HEAD = 1 << 18
# The first of the words, whose pairs are counted in advance.
FIRST = 1 << 12
# Classes of counts to each doubling, by which the frequent words are told from the rest.
STEPS = 4

# Texts that are looked up at once.
TEXTS = 64
LOSSES = ("target_loss", "background_loss")

# A pair's ``key`` deals it out. Pairs of two frequent words have their places there; pairs of a rare
# word and a frequent one have a hash, and the latter's place as ``pair``. Pairs whose second word is
# rare lie with that word, so that it is counted there as well, and have their hash as ``pair``.
FREQUENT, RARE_FIRST, RARE_SECOND = range(3)
# Null texts of the models' own documents are left out of the counts: a pair that only they have costs nothing.
KIND, COUNTED, GOOD, LEFT_OUT = 3, 4, 8, 16
PLACE_BITS = 20
PLACES = (1 << PLACE_BITS) - 1
SIGN = np.int64(-(1 << 63))
MIX = np.uint64(0x9E3779B97F4A7C15)

# What moves: arrays of pairs and of what they add to texts, beside rows of single texts. Arrays are dealt by the first.
PAIRS = {"keys": pa.int64(), "pairs": pa.int64(), "abouts": pa.int8(), "ns": pa.int32(), "rows": pa.int64()}
ADDED = {"rows": pa.int64(), "targets": pa.float64(), "backgrounds": pa.float64()}
TEXT = ("row", "doc_id", "tokens", *LOSSES)


def _hashes(text: str | None) -> np.ndarray:
    """Words, digits and single symbols of a whole text, as hashes."""
    return tokens(code_points(text or ""), symbols=True).hash.view(np.int64)


def _ended(text: str | None) -> np.ndarray:
    """The words between two ends."""
    return np.concatenate([[END], _hashes(text), [END]])


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of each word with the one before it: the latter turned by a bit, so that their order counts."""
    turned = before.view(np.uint64)
    return ((turned << np.uint64(1) | turned >> np.uint64(63)) ^ word.view(np.uint64)).view(np.int64)


def _stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder: columns of counts shrink there, as they do not in a checkpoint."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/models-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _name(docs: DataFrame) -> str:
    """The type an id has on its way: numbers are summed up faster than strings."""
    return "long" if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") else "string"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("doc_id").cast(_name(docs)).alias("name"), "text")


def _flagged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """row, name, text and ``good``, whether the id is among ``ids`` (_target).

    A Bloom filter finds them where the texts are; ids that it takes for others are told by an exact join of ids.
    """
    filter_ = bloom.build(ids, "_target")
    maybe = filter_.flag(docs.select("doc_id"), F.col("doc_id"), "_maybe").where("_maybe")
    wrong = _stored(maybe.select(F.col("doc_id").alias("_wrong")).distinct().join(ids, F.col("_wrong") == F.col("_target"), "left_anti"))
    judged = filter_.flag(_numbered(docs), F.col("doc_id"), "_maybe")
    # Few of them, so that texts need not move.
    judged = judged.join(wrong, F.col("_maybe") & (F.col("doc_id") == F.col("_wrong")), "left")
    return judged.select("row", "name", "text", (F.col("_maybe") & F.col("_wrong").isNull()).alias("good"))


def _summed(texts: DataFrame, codes: Callable[[np.ndarray], np.ndarray], columns: tuple[str, str, str]) -> DataFrame:
    """How often each of the ``codes`` of a text's words stands in texts that are ``good``, and in all."""
    code, good_n, every_n = columns

    def counted(held: list[np.ndarray], good: list[bool]) -> pd.DataFrame:
        every = np.concatenate([np.zeros(0, np.int64), *held])
        values, at = np.unique(every, return_inverse=True)
        of_good = np.repeat(np.array(good, bool), [len(h) for h in held])
        return pd.DataFrame({
            code: values, good_n: np.bincount(at[of_good], minlength=len(values)), every_n: np.bincount(at, minlength=len(values)),
        })

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        good: list[bool] = []
        waiting = 0
        for batch in batches:
            for text, flag in zip(batch["text"], batch["good"], strict=True):
                held.append(codes(_ended(text)))
                good.append(flag)
                waiting += len(held[-1])
                if waiting >= HELD:
                    yield counted(held, good)
                    held, good, waiting = [], [], 0
        yield counted(held, good)

    rows = texts.where(F.col("text").isNotNull()).select("text", "good")
    parts = rows.mapInPandas(count, f"{code} long, {good_n} long, {every_n} long")
    return parts.groupBy(code).agg(F.sum(good_n).alias(good_n), F.sum(every_n).alias(every_n))


def loss(pair, before, word, total, kinds, log=np.log):
    """Loss, in nats, of a word after another: pairs, backed off to words with one added to each.

    ``pair`` and ``before`` count the pair and its first word, ``word`` the second one among
    ``total`` of so many ``kinds``. Numbers, arrays or, with their logarithm, columns.
    """
    return log(before + BACK_OFF) - log(pair + (word + 1.0) * BACK_OFF / (total + kinds))


def losses(counts: np.ndarray) -> np.ndarray:
    """The loss of each word after each, of a table of counts."""
    single = counts.sum(axis=0)
    return loss(counts, counts.sum(axis=1, keepdims=True), single, single.sum(), len(single))


@dataclass(frozen=True)
class Frequent:
    """The frequent words and pairs."""

    sorted: np.ndarray  # words
    place: np.ndarray  # of each of them, the most frequent first
    counts: tuple[np.ndarray, np.ndarray]  # by place: in the target, in all texts
    codes: np.ndarray  # of the pairs, sorted
    losses: tuple[np.ndarray, np.ndarray]  # of each of them

    def places(self, words: np.ndarray) -> np.ndarray:
        """Places of words, -1 for rare ones."""
        if not len(self.sorted):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.place[at], -1)


@dataclass(frozen=True)
class Models:
    """Counts of words in the target (``_t``) and in all texts (``_b``), and where those of pairs come from."""

    docs: DataFrame
    texts: DataFrame  # row, name, text, good
    words: DataFrame  # kind, kind_t, kind_b
    target_total: int
    total: int
    kinds: int  # different words, and one more for all others
    flat: bool  # whether there are no target texts, so that both models are the background

    @property
    def scale(self) -> float:
        return 1.0 if self.flat else self.target_total / max(self.total, 1)

    @property
    def target(self) -> np.ndarray:
        """The target's loss of a word that no text holds, after another."""
        return np.array([loss(0.0, 0.0, 0.0, self.total if self.flat else self.target_total, self.kinds)])

    @property
    def background(self) -> np.ndarray:
        return np.array([loss(0.0, 0.0, 0.0, self.total * self.scale, self.kinds)])

    def losses(self, pair: tuple, word: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Losses of words by their counts and those of their pairs, each in the target and in all texts.

        In a text, the words that others follow are those that follow others, as its ends are one
        word. So each word stands in for the one before it, and a text's sum is the same.
        """
        scaled = pair[1] * self.scale, word[1] * self.scale
        usual = loss(scaled[0], scaled[1], scaled[1], self.total * self.scale, self.kinds)
        return usual if self.flat else loss(pair[0], word[0], word[0], self.target_total, self.kinds), usual


def good_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): documents with label quality 1 and not toxic, each once."""
    good = labels.where((F.col("quality") == 1) & ~(F.coalesce(F.col("toxic"), F.lit(0)) == 1))
    return good.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()


def fit(docs: DataFrame, target: DataFrame) -> Models:
    """Matched models of all ``docs`` (doc_id, text) and of those in ``target`` (doc_id): all
    words, and one smoothing.

    The background model counts all texts, the target model those of its
    documents, each row once. Background counts are scaled to the target's
    sum, so that smoothing weighs the same in both: what a background sample
    of the target's size would hold, without its noise. Without target texts
    both models are the background.

    Tasks sum up the counts of theirs, Spark the sums.
    """
    ids = target.select(F.col("doc_id").alias("_target")).where(F.col("_target").isNotNull()).distinct()
    # Every word but the last end follows another, and the first end stands for it.
    texts = _flagged(docs, ids)
    words = _stored(_summed(texts, lambda ended: ended[1:], ("kind", "kind_t", "kind_b")))
    sums = words.agg(F.sum("kind_t").alias("t"), F.sum("kind_b").alias("b"), F.count("*").alias("n")).first()
    return Models(docs, texts, words, sums["t"] or 0, sums["b"] or 0, sums["n"] + 1, not sums["t"])


def _head(counts: DataFrame, by: str) -> pd.DataFrame:
    """The most frequent rows, whole classes of counts ``by``: ``HEAD`` at most."""
    step = F.floor(F.log2(by) * STEPS)
    classes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    least, rows = None, 0
    for r in sorted(classes, key=lambda r: -r["step"]):
        rows += r["n"]
        if rows > HEAD:
            break
        least = r["step"]
    return (counts.limit(0) if least is None else counts.where(step >= least)).toPandas()


def _frequent(models: Models) -> Frequent:
    head = _head(models.words, "kind_b").sort_values(["kind_b", "kind"], ascending=[False, True])
    words = head["kind"].to_numpy(np.int64)
    order = np.argsort(words)
    counts = head["kind_t"].to_numpy(np.float64), head["kind_b"].to_numpy(np.float64)
    none = np.zeros(0)
    first = Frequent(words[order], order, counts, none, (none, none))
    if not len(words):
        return first
    few = np.argsort(words[:FIRST])
    some = Frequent(words[:FIRST][few], few, (none, none), none, (none, none))
    pairs = _head(_stored(_summed(models.texts, lambda ended: _codes(some.places(ended)), ("code", "t", "b"))), "b").sort_values("code")
    codes = pairs["code"].to_numpy(np.int64)
    word = tuple(n[codes & PLACES] for n in counts)
    return Frequent(words[order], order, counts, codes, models.losses((pairs["t"].to_numpy(np.float64), pairs["b"].to_numpy(np.float64)), word))


def _codes(places: np.ndarray) -> np.ndarray:
    """Codes of the pairs of two words with places."""
    both = (places[:-1] >= 0) & (places[1:] >= 0)
    return (places[:-1][both] << PLACE_BITS) | places[1:][both]


def score(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, tokens, target_loss, background_loss and score of each row of ``docs`` (doc_id, text).

    ``score`` is the target's mean loss per token less the background's: the
    lower, the more a text is like the target. Null and empty texts are scored
    on their end alone. Repeated rows are each given; other columns are left
    out, whatever their names.

    A text's most frequent pairs are looked up where it is read. Each of its
    others moves once, with the text's number, to where all texts' pairs like it are
    counted. A pair of a frequent word is first weighed as if it stood in
    no other text, as most do; so only other texts' pairs go back, to be summed up by text.
    Pairs move in arrays, those of many texts for one bucket in a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(models))
    name = _name(docs)
    kept = pa.int64() if name == "long" else pa.string()
    # The models without their tables, which stay with the driver.
    totals = Models(None, None, None, models.target_total, models.total, models.kinds, models.flat)

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(models.total // BUCKET + 1, LEAST, partitions)
    parts = max(models.total // PART + 1, partitions)
    text = f"row long, doc_id {name}, tokens int, target_loss double, background_loss double"

    def pairs_of(texts: DataFrame, scored: bool, uncounted: int = 0) -> DataFrame:
        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, waiting = [], 0
            for batch in batches:
                for start in range(0, batch.num_rows, TEXTS):
                    own, pairs = _looked_up(batch.slice(start, TEXTS), shared.value, totals, scored, kept, uncounted)
                    if scored:
                        yield _texts(own, PAIRS, buckets)
                    held.append(pairs)
                    waiting += len(pairs[0])
                    if waiting >= HELD:
                        yield _arrays(held, PAIRS, buckets, kept)
                        held, waiting = [], 0
            if held:
                yield _arrays(held, PAIRS, buckets, kept)

        columns = texts.select("row", F.col("name").cast(name).alias("name"), "text", "good", "counted")
        arrays = "keys array<long>, pairs array<long>, abouts array<tinyint>, ns array<int>, rows array<long>"
        return columns.mapInArrow(look_up, f"bucket int, {arrays}, {text}")

    if docs.sameSemantics(models.docs):
        rows = pairs_of(models.texts.withColumn("counted", F.col("text").isNotNull()), True, LEFT_OUT)
    else:
        # Texts that the models count, and others that they do not.
        held = models.texts.where(F.col("text").isNotNull()).withColumn("counted", F.lit(True))
        others = _numbered(docs).drop("doc_id").withColumns({"good": F.lit(False), "counted": F.lit(False)})
        rows = pairs_of(others, True).unionByName(pairs_of(held, False))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, held in _buckets(batches, PAIRS):
            for own in texts:
                yield _texts(own, ADDED, parts)
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            order = np.argsort(columns[0])
            columns = [c[order] for c in columns]
            key, added, start = columns[0], [], 0
            while start < len(key):
                # The pairs of a key are weighed together.
                end = int(np.searchsorted(key, key[min(start + WEIGHED, len(key)) - 1], side="right"))
                added.append(_weighed(*[c[start:end] for c in columns], shared.value, totals))
                start = end
            if added:
                yield _arrays([_by_row(added)], ADDED, parts, kept)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, held in _buckets(batches, ADDED, _by_row):
            row, *sums = _by_row(held)
            for own in texts:
                at = np.searchsorted(row, own["row"].to_numpy())
                found = np.append(row, -1)[at] == own["row"].to_numpy()
                losses_ = [own[c].to_numpy() + np.where(found, np.append(v, 0.0)[at], 0.0) for c, v in zip(LOSSES, sums, strict=True)]
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["tokens"].cast(pa.int64()), *map(pa.array, losses_)], names=["doc_id", "tokens", *LOSSES])

    weighed = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(weigh, f"bucket int, rows array<long>, targets array<double>, backgrounds array<double>, {text}")
    sums = weighed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sum_up, f"doc_id {name}, tokens long, target_loss double, background_loss double")
    kind = dict(docs.dtypes)["doc_id"]
    means = sums.select(F.col("doc_id").cast(kind).alias("doc_id"), "tokens", *[(F.col(c) / F.col("tokens")).alias(c) for c in LOSSES])
    return means.withColumn("score", F.col(LOSSES[0]) - F.col(LOSSES[1]))


def _looked_up(batch: pa.RecordBatch, frequent: Frequent, models: Models, scored: bool, kept: pa.DataType, uncounted: int) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
    """A row for each text, with the losses of its most frequent pairs, and its other pairs (``PAIRS``)."""
    texts = [_ended(text) for text in batch["text"].to_pylist()]
    row, counted, good = (np.asarray(batch[c].to_pylist()) for c in ("row", "counted", "good"))
    n = np.array([len(t) - 1 for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts), dtype=np.uint8), n)
    every = np.concatenate(texts)
    places = frequent.places(every)
    # Each text has one word more than pairs: all but its last are first words.
    first = np.delete(np.arange(len(every)), np.cumsum(n + 1) - 1)
    a, b = places[first], places[first + 1]
    known = [np.zeros(len(texts)) for _ in LOSSES]
    if len(frequent.codes):
        code = np.where((a >= 0) & (b >= 0), (a << PLACE_BITS) | b, -1)
        at = np.minimum(np.searchsorted(frequent.codes, code), len(frequent.codes) - 1)
        found = frequent.codes[at] == code
        known = [np.bincount(of[found], loss_[at[found]], len(texts)) for loss_ in frequent.losses]
        of, a, b, first = of[~found], a[~found], b[~found], first[~found]
    hashed = _pairs(every[first], every[first + 1])
    at, m = _different(of, hashed)
    of, a, b, hashed, word = of[at], a[at], b[at], hashed[at], every[first[at] + 1]
    kinds = np.where(b < 0, RARE_SECOND, np.where(a < 0, RARE_FIRST, FREQUENT))
    flags = (np.where(counted, COUNTED, uncounted) | np.where(good, GOOD, 0))[of]
    if scored:
        usual = (b >= 0) & ((flags & LEFT_OUT) == 0)
        own = [l_ * m[usual] for l_ in _alone(m[usual], flags[usual], b[usual], frequent, models)]
        known = [k + np.bincount(of[usual], l_, len(texts)) for k, l_ in zip(known, own, strict=True)]
    own = pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), batch["name"].cast(kept), pa.array(n.astype(np.int32)), *[pa.array(k.astype(np.float64)) for k in known]], names=TEXT)
    key = np.choose(kinds, [(a << PLACE_BITS) | b, hashed | SIGN, word | SIGN])
    pair = np.choose(kinds, [np.zeros(len(b), np.int64), b, hashed])
    return own, (key, pair, (kinds | flags).astype(np.int8), m.astype(np.int32), row[of] if scored else np.full(len(of), -1))


def _bucket(values: np.ndarray, count: int) -> np.ndarray:
    return ((values.view(np.uint64) * MIX >> np.uint64(20)) % np.uint64(count)).astype(np.int32)


def _texts(own: pa.RecordBatch, fields: Mapping[str, pa.DataType], count: int) -> pa.RecordBatch:
    """Rows of single texts, dealt to one of ``count`` buckets."""
    bucket = pa.array(_bucket(own["row"].to_numpy(), count))
    none = [pa.nulls(own.num_rows, pa.list_(kind)) for kind in fields.values()]
    return pa.RecordBatch.from_arrays([bucket, *none, *own.columns], names=["bucket", *fields, *TEXT])


def _arrays(held: list[tuple[np.ndarray, ...]], fields: Mapping[str, pa.DataType], count: int, kept: pa.DataType) -> pa.RecordBatch:
    """A row of arrays for each of the ``count`` buckets that any of the first values is dealt to."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    bucket = _bucket(columns[0].astype(np.int64), count)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(_starts(bucket))
    ends = pa.array(np.append(at, len(bucket)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(c[order], kind)) for c, kind in zip(columns, fields.values(), strict=True)]
    none = [pa.nulls(len(at), kind) for kind in (pa.int64(), kept, pa.int32(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), *lists, *none], names=["bucket", *fields, *TEXT])


def _buckets(batches: Iterator[pa.RecordBatch], fields: Mapping[str, pa.DataType], fold: Callable | None = None) -> Iterator[tuple[list, list]]:
    """For each bucket of sorted rows, those of texts and the arrays, which ``fold`` makes smaller."""
    at, texts, held, waiting = None, [], [], 0
    for batch in batches:
        bucket = batch["bucket"].to_numpy()
        for start, end in pairwise(np.append(np.flatnonzero(_starts(bucket)), len(bucket)).tolist()):
            if bucket[start] != at:
                if at is not None:
                    yield texts, held
                at, texts, held, waiting = bucket[start], [], [], 0
            rows = batch.slice(start, end - start)
            texts.append(rows.filter(rows["row"].is_valid()).select(TEXT))
            held.append(tuple(rows[c].flatten().to_numpy() for c in fields))
            waiting += len(held[-1][0])
            if fold and waiting >= HELD:
                held, waiting = [fold(held)], 0
    if at is not None:
        yield texts, held


def _by_row(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The sums of each text's row, in order of rows."""
    row, *values = (np.concatenate(c) for c in zip(*held, strict=True))
    rows, at = np.unique(row, return_inverse=True)
    return rows, *[np.bincount(at, v, len(rows)) for v in values]


def _alone(n: np.ndarray, flags: np.ndarray, place: np.ndarray, frequent: Frequent, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Losses of frequent words after words that they follow in no other text."""
    seen = n * ((flags & COUNTED) != 0).astype(np.float64)
    return models.losses((seen * ((flags & GOOD) != 0), seen), tuple(c[place] for c in frequent.counts))


def _different(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different values of each text, and how often each stands there."""
    order = np.argsort(values)
    order = order[np.argsort(of[order], kind="stable")]
    at = np.flatnonzero(_starts(of[order], values[order]))
    return order[at], np.diff(np.append(at, len(order)))


def _starts(*values: np.ndarray) -> np.ndarray:
    """Where sorted values are not those before."""
    starts = np.ones(len(values[0]), bool)
    starts[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    return starts


def _weighed(key: np.ndarray, pair: np.ndarray, about: np.ndarray, n: np.ndarray, row: np.ndarray, frequent: Frequent, models: Models) -> tuple[np.ndarray, ...]:
    """What the losses of other pairs than a text's most frequent ones add to it (``ADDED``); all pairs of a key are there."""
    order = np.lexsort((pair, key))
    key, pair, about, n, row = key[order], pair[order], about[order], n[order], row[order]
    seen = n * ((about & COUNTED) != 0).astype(np.float64)
    good = seen * ((about & GOOD) != 0)
    kinds = about & KIND
    by_pair, by_key = np.cumsum(_starts(key, pair)) - 1, np.cumsum(_starts(key)) - 1
    pairs = [np.bincount(by_pair, v)[by_pair] for v in (good, seen)]
    rare = kinds == RARE_SECOND
    place = np.where(kinds == FREQUENT, key & PLACES, pair)
    words = []
    for v, counts in zip((good, seen), frequent.counts, strict=True):
        word = np.bincount(by_key, v * rare)[by_key] if len(v) else v
        word[~rare] = counts[place[~rare]]
        words.append(word)
    # Frequent words have been weighed as if their pair stood in no other text.
    left_out = (about & LEFT_OUT) != 0
    wanted = (row >= 0) & np.where(left_out, pairs[1] > 0, rare | (pairs[0] != good) | (pairs[1] != seen))
    before = [np.where((rare | left_out)[wanted], 0.0, l_) for l_ in _alone(n[wanted], about[wanted], np.where(rare, 0, place)[wanted], frequent, models)] if len(frequent.sorted) else [0.0, 0.0]
    after = models.losses(tuple(p[wanted] for p in pairs), tuple(w[wanted] for w in words))
    return row[wanted], *[(l_ - was) * n[wanted] for l_, was in zip(after, before, strict=True)]
