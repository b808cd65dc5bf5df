"""Titles, summaries, vectors and metadata of chunks, computed once per distinct content.

The defaults are native: an extractive title and summary, and a hashed
bag-of-words vector. A model takes their place through the hooks.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.json import FALLBACK_SUMMARY, FALLBACK_TITLE, is_fallback
from docloom.functions.text import prompt_excerpt, squash, strip, words
from docloom.functions.urls import document_path, url_path
from docloom.schema import VECTOR_WIDTH
from docloom.session import cut_lineage

# Tasks get this module's code with their closures; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of a chunk's metadata.
CHUNK_SOURCE = "pydantic_ai_docs"

Hook = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# A hook gets (memo_key, url, content, request) and gives this.
TITLE_REPLY = "memo_key string, title string, summary string, cost double, tokens int"
VECTOR_REPLY = "memo_key string, embedding array<float>, cost double, tokens int"


# --- keys ---------------------------------------------------------------------------------


def capture_key(url: Column) -> Column:
    return F.sha2(url, 256)


def title_key(url: Column, content: Column, model: str | None = None) -> Column:
    """Hash of the chunk with its URL; the model is part of it when one is named."""
    parts = [url, content] if model is None else [F.lit(model), url, content]
    return F.sha2(F.concat_ws(":", *parts), 256)


def vector_key(content: Column, model: str | None = None) -> Column:
    return F.sha2(content if model is None else F.concat_ws(":", F.lit(model), content), 256)


# --- default title and summary ------------------------------------------------------------


def extract_title(content: Column) -> Column:
    """First heading of the chunk, else the first sentence of its first line, else that line."""
    found = [r"(?m)^#{1,6} +(\S[^\n]*)", r"^\s*([^\n]*?[.!?])(?:\s|$)", r"^\s*([^\n]*)"]
    matches = [F.nullif(F.regexp_extract(content, p, 1), F.lit("")) for p in found]
    return squash(F.coalesce(*matches, F.lit("")))


def extract_summary(content: Column) -> Column:
    """The first two sentences of the chunk, headings left out; all of it if it has none."""
    body = squash(F.regexp_replace(content, r"(?m)^#{1,6} [^\n]*", " "))
    lead = strip(F.regexp_extract(body, r"^(?:.*?[.!?](?: |$)){1,2}", 0))
    return F.coalesce(F.nullif(lead, F.lit("")), body)


# --- default vector -----------------------------------------------------------------------


def _word_codes(word: str, width: int) -> tuple[int, int]:
    """Bucket and sign of a word, from its hash."""
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16) % width, -1 if digest[8] >= "8" else 1


def _dense(width: int) -> Callable[[Column], Column]:
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def dense(tokens: pa.Array) -> pa.Array:
        rows = len(tokens)
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        # A batch has far fewer different words than words: hash each once.
        codes = [_word_codes(word, width) for word in coded.dictionary.to_pylist()]
        bucket, sign = np.array(codes, dtype=np.int64).reshape(-1, 2).T
        word = coded.indices.to_numpy(zero_copy_only=False)
        cells = np.repeat(np.arange(rows), sizes) * width + bucket[word]
        counts = np.bincount(cells, weights=sign[word], minlength=rows * width)
        counts = counts.reshape(rows, width)
        length = np.sqrt((counts * counts).sum(axis=1))
        unit = counts / np.where(length == 0, 1.0, length)[:, None]
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
        return pa.ListArray.from_arrays(offsets, pa.array(unit.astype(np.float32).ravel()))

    return dense


def hashed_vector(content: Column, width: int = VECTOR_WIDTH) -> Column:
    """Unit vector of signed counts of hashed words; zero for a text without words.

    Texts are split in the JVM; one Arrow batch of words becomes one block of
    vectors. No exchange: a chunk never leaves its task.
    """
    return _dense(width)(words(content))


# --- memoised calls -----------------------------------------------------------------------


@dataclass
class Memoised:
    """``rows`` with their values, the ``additions`` to the memo, and ``usage`` per call."""

    rows: DataFrame
    additions: DataFrame
    usage: DataFrame


def memo_misses(keyed: DataFrame, memo: DataFrame, inputs: list[str]) -> DataFrame:
    """One row per key that the memo lacks.

    Copies of a text shrink to one row per task before the exchange, however
    many there are.
    """
    wanted = keyed.groupBy("memo_key").agg(*[F.any_value(c).alias(c) for c in inputs])
    return wanted.join(memo_hits(keyed, memo).select("memo_key"), "memo_key", "left_anti")


# A stored memo is laid out by this column, a hash of the key: so many folders, whatever its size.
MEMO_PART = "memo_part"
MEMO_PARTS = 64


def memo_part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MEMO_PARTS)).cast("int")


def memo_values(memo: DataFrame) -> list[str]:
    return [c for c in memo.columns if c not in ("memo_key", MEMO_PART)]


def memo_hits(keyed: DataFrame, memo: DataFrame) -> DataFrame:
    """The memo's rows for the wanted keys.

    An inner join, so that the keys of a small batch can be sent to a large
    memo rather than the memo be shuffled. Of a stored memo only the folders are
    read that the keys fall in; their numbers, at most ``MEMO_PARTS``, are found first.
    A key that was stored twice counts once.
    """
    values = memo_values(memo)
    if MEMO_PART in memo.columns:
        wanted = [r["part"] for r in keyed.select(memo_part(F.col("memo_key")).alias("part")).distinct().collect()]
        memo = memo.where(F.col(MEMO_PART).isin(wanted)).drop(MEMO_PART)
    hits = memo.join(keyed.select("memo_key").distinct(), "memo_key")
    return hits.groupBy("memo_key").agg(F.first(F.struct(*values)).alias("v")).select("memo_key", "v.*")


def memoised(
    keyed: DataFrame,
    memo: DataFrame,
    inputs: list[str],
    compute: Callable[[DataFrame], DataFrame],
    kind: str,
    failed: Column,
) -> Memoised:
    """Look values up by ``memo_key``, compute each missing one once.

    Failed calls give their fallback to their rows but do not enter the memo.
    """
    values = memo_values(memo)
    hits = cut_lineage(memo_hits(keyed, memo).select("memo_key", *values))
    computed = cut_lineage(compute(memo_misses(keyed, hits, inputs)))
    known = hits.withColumn("memo_hit", F.lit(True)).unionByName(
        computed.select("memo_key", *values, F.lit(False).alias("memo_hit"))
    )
    return Memoised(
        rows=keyed.join(known, "memo_key", "left"),
        additions=computed.where(~failed).select("memo_key", *values),
        usage=computed.select(F.lit(kind).alias("kind"), "cost", "tokens"),
    )


def native_titles(misses: DataFrame) -> DataFrame:
    return misses.select(
        "memo_key",
        extract_title(F.col("content")).alias("title"),
        extract_summary(F.col("content")).alias("summary"),
        F.lit(0.0).alias("cost"),
        F.size(words(prompt_excerpt(F.col("url"), F.col("content")))).alias("tokens"),
    )


def native_vectors(width: int) -> Callable[[DataFrame], DataFrame]:
    def compute(misses: DataFrame) -> DataFrame:
        return misses.select(
            "memo_key",
            hashed_vector(F.col("content"), width).alias("embedding"),
            F.lit(0.0).alias("cost"),
            F.size(words(F.col("content"))).alias("tokens"),
            # A text without words has the zero vector, and rightly so.
            F.lit(False).alias("failed"),
        )

    return compute


def _guarded(hook: Hook, reply: str, rows: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``hook`` on one batch at a time, of at most ``rows`` if given: if it raises, that batch has no replies.

    Replies travel by Spark's batch, however small the hook's are.
    """
    names = [*(field.split()[0] for field in reply.split(", ")), "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = len(batch) if rows is None else rows
            found: dict[str, list] = {name: [] for name in names}
            for start in range(0, len(batch), max(size, 1)):
                part = batch if size >= len(batch) else batch.iloc[start : start + size].reset_index(drop=True)
                try:
                    replies = list(hook(iter([part])))
                except Exception as error:  # any fault of a model call is the fault of its batch alone
                    replies = [pd.DataFrame({"memo_key": part["memo_key"], "error": repr(error)[:1000]})]
                for answer in replies:
                    for name in names:
                        found[name] += answer[name].tolist() if name in answer else [None] * len(answer)
            # Plain objects: whatever types the hook's frames have, Arrow builds one array of each.
            plain = pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in found.items()})
            yield plain.where(plain.notna(), None)

    return run


def _replies(misses: DataFrame, asked: DataFrame, hook: Hook, reply: str, rows: int | None = None) -> DataFrame:
    """One row per missing key: its first reply, or NULLs if the hook gave none."""
    given = asked.mapInPandas(_guarded(hook, reply, rows), f"{reply}, error string")
    values = [c for c in given.columns if c != "memo_key"]
    one = given.groupBy("memo_key").agg(F.first(F.struct(*values)).alias("r")).select("memo_key", "r.*")
    return misses.select("memo_key").join(one, "memo_key", "left")


def hooked_titles(hook: Hook) -> Callable[[DataFrame], DataFrame]:
    """Titles from a user's batch function over ``(memo_key, url, content, request)``.

    A chunk without a reply, with half a reply, or in a batch for which the
    hook raised gets both fallback texts, counts as failed and is not
    memoised; ``error`` says what the hook raised.
    """

    def compute(misses: DataFrame) -> DataFrame:
        misses = cut_lineage(misses)
        asked = misses.withColumn("request", prompt_excerpt(F.col("url"), F.col("content")))
        replies = _replies(misses, asked, hook, TITLE_REPLY)
        whole = F.col("title").isNotNull() & F.col("summary").isNotNull()
        return replies.select(
            "memo_key",
            F.when(whole, F.col("title")).otherwise(FALLBACK_TITLE).alias("title"),
            F.when(whole, F.col("summary")).otherwise(FALLBACK_SUMMARY).alias("summary"),
            F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "error",
        )

    return compute


def hooked_vectors(hook: Hook, width: int, rows: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Vectors from a user's batch function; a missing or misshapen one becomes zero and is not memoised.

    ``rows`` bounds the texts of one call, and so what a call that raises leaves without a reply.
    """

    def compute(misses: DataFrame) -> DataFrame:
        misses = cut_lineage(misses)
        zero = F.array_repeat(F.lit(0.0).cast("float"), width)
        sound = (F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull())
        return _replies(misses, misses, hook, VECTOR_REPLY, rows).select(
            "memo_key",
            F.when(F.coalesce(sound, F.lit(False)), F.col("embedding")).otherwise(zero).alias("embedding"),
            F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            (~F.coalesce(sound, F.lit(False))).alias("failed"), "error",
        )

    return compute


def titles_failed() -> Column:
    return is_fallback(F.col("title"), F.col("summary"))


# --- chunk records ------------------------------------------------------------------------


def iso_utc(moment: Column) -> Column:
    """ISO-8601 UTC stamp with microseconds."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def chunk_metadata(url: Column, content: Column, as_of: Column, source: str = CHUNK_SOURCE) -> Column:
    """Compact JSON metadata of one chunk; ``source`` names where its tool's documentation comes from."""
    return F.to_json(
        F.struct(
            F.lit(source).alias("source"),
            F.length(content).alias("chunk_size"),
            iso_utc(as_of).alias("crawled_at"),
            url_path(url).alias("url_path"),
            document_path(url).alias("file_path"),
        )
    )


def enrich(chunks: DataFrame, as_of: Column, width: int = VECTOR_WIDTH) -> DataFrame:
    """Chunk records by the native defaults, without a memo: narrow, no exchange."""
    content = F.col("content")
    return chunks.select(
        *chunks.columns,
        extract_title(content).alias("title"),
        extract_summary(content).alias("summary"),
        chunk_metadata(F.col("url"), content, as_of).alias("metadata"),
        hashed_vector(content, width).alias("embedding"),
    )


def enrich_memoised(
    chunks: DataFrame,
    as_of: Column,
    title_memo: DataFrame,
    vector_memo: DataFrame,
    titles: Callable[[DataFrame], DataFrame] = native_titles,
    vectors: Callable[[DataFrame], DataFrame] | None = None,
    title_model: str = "native",
    vector_model: str = "native",
    width: int = VECTOR_WIDTH,
) -> tuple[DataFrame, Memoised, Memoised]:
    """Chunk records through the memos; also what each memo gains and what was spent."""
    content, url = F.col("content"), F.col("url")
    titled = memoised(
        chunks.withColumn("memo_key", title_key(url, content, title_model)),
        title_memo, ["url", "content"], titles, "completion", titles_failed(),
    )
    embedded = memoised(
        titled.rows.drop("memo_hit").withColumn("memo_key", vector_key(content, vector_model)),
        vector_memo, ["content"], vectors or native_vectors(width), "embedding", F.col("failed"),
    )
    records = embedded.rows.drop("memo_key", "memo_hit").withColumn(
        "metadata", chunk_metadata(url, content, as_of)
    )
    return records, titled, embedded
