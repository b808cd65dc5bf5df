"""Filtered cosine search over tools, pages and chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.json import contains_metadata
from docloom.functions.vectors import RANK_DECIMALS
from docloom.operators.enrichment import Memoised, memoised, native_vectors, vector_key
from docloom.operators.topk import NAN_KEY, NULL_KEY, Nearest, Shared, cosine_keys, scan_vectors, top_vectors
from docloom.schema import VECTOR_WIDTH
from docloom.session import cut_lineage

SEARCH_COLUMNS = (
    "id", "url", "tool_name", "source_type", "chunk_number",
    "title", "summary", "content", "metadata", "similarity",
)
RESULT_COLUMNS = (
    "title", "source_url", "tool_name", "source_type",
    "summary", "similarity", "chunk_number", "content",
)
DEFAULT_MATCHES = 10
# Hits of this many rows take at most 10 MB; only so many are sent to every task.
BROADCAST_HITS = 250_000


@dataclass
class KnowledgeBase:
    """The three tables that search reads."""

    tool_docs: DataFrame
    page: DataFrame
    page_chunk: DataFrame


def pages_with_tools(kb: KnowledgeBase, filter: dict | None = None) -> DataFrame:
    """``(page_id, url, tool_name, source_type)`` of the tools whose metadata holds ``filter``."""
    tools = kb.tool_docs
    if filter:
        tools = tools.where(contains_metadata(F.col("metadata"), filter))
    tools = tools.select(F.col("id").alias("tool_id"), "tool_name", "source_type")
    return (
        kb.page.select(F.col("id").alias("page_id"), "tool_id", "url")
        .join(tools, "tool_id")
        .drop("tool_id")
    )


def joined_chunks(kb: KnowledgeBase, filter: dict | None = None) -> DataFrame:
    """Every chunk with its page and tool.

    Which side to broadcast is left to Spark's own size check; beyond it the
    joins shuffle on their keys, and a page or tool with very many rows is
    split by the skew join.
    """
    return kb.page_chunk.join(pages_with_tools(kb, filter), "page_id")


def _in_tools(chunks: DataFrame, kb: KnowledgeBase, filter: dict | None) -> DataFrame:
    """Chunks of the tools that pass the filter; without one, every chunk has a tool."""
    if not filter:
        return chunks
    return chunks.join(pages_with_tools(kb, filter).select("page_id"), "page_id", "left_semi")


def _described(kb: KnowledgeBase, hits: DataFrame, extra: list[str]) -> DataFrame:
    """Texts, page and tool of the chunks that were found."""
    texts = kb.page_chunk.select(
        "id", "page_id", "chunk_number", "title", "summary", "content", "metadata"
    )
    return (
        texts.join(hits, "id")
        .join(pages_with_tools(kb), "page_id")
        .select(*extra, *SEARCH_COLUMNS)
    )


def match_chunks(
    kb: KnowledgeBase,
    vector: list[float],
    match_count: int = DEFAULT_MATCHES,
    filter: dict | None = None,
) -> DataFrame:
    """The chunks nearest to one vector, as ``SEARCH_COLUMNS`` in order.

    Vectors are reduced to distances in the scan; ids and distances are all
    that is joined and ranked. Numbers come first, then NaN (zero vectors),
    then NULL (chunks without a vector). Texts, page and tool of the ids found
    are joined to them; nothing runs before the result is asked for. Chunks
    must have a page and a tool: the store's references see to that.
    """
    ranked = kb.page_chunk.select("id", "page_id", _distance_to(vector)("embedding").alias("distance"))
    order = [F.asc_nulls_last("distance"), F.asc("id")]
    hits = _in_tools(ranked, kb, filter).orderBy(*order).limit(match_count)
    hits = hits.select("id", "distance", (1 - F.col("distance")).alias("similarity"))
    # Spark cannot foresee that a scan of all vectors ends in few rows; this bound is exact.
    if match_count <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    return _described(kb, hits, ["distance"]).orderBy(*order).drop("distance")


def _distance_to(vector: list[float]) -> Callable[[str], Column]:
    """Distance of a column of vectors to one vector, a block at a time.

    On vectors of 1536 numbers this takes a quarter of the time of the array
    functions, which are not compiled.
    """
    query = np.array([vector], dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def distance(column: pa.Array) -> pa.Array:
        keys = cosine_keys(query, column, RANK_DECIMALS)[0]
        return pa.array(np.where(keys == NAN_KEY, np.nan, keys), mask=keys == NULL_KEY, from_pandas=False)

    return distance


def search_result(matches: DataFrame, *extra: str) -> DataFrame:
    """The columns that a search answers with."""
    return matches.withColumnRenamed("url", "source_url").select(*extra, *RESULT_COLUMNS)


def nearest(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, similarity)``: the k nearest ``items(id, embedding)`` of each query.

    ``queries(query_id, vector)`` may be of any length; it is taken in blocks,
    which all visit the items. Those are made once, and of items without a
    vector, which are equally far from all queries, only the first k are kept.
    """
    made = cut_lineage(items.select("id", "embedding"))
    known = made.where(F.col("embedding").isNotNull())
    unknown = made.where(F.col("embedding").isNull()).orderBy("id").limit(k)
    held = cut_lineage(known.unionByName(unknown))

    def scan_block(block: tuple[np.ndarray, np.ndarray], share: Shared) -> DataFrame:
        ids, matrix = block
        shared = share(matrix)

        def visit(best: Nearest, batch: pa.RecordBatch) -> None:
            best.visit(None, batch.column("embedding"), batch.column("id").to_numpy())

        return scan_vectors(held, ids, k, lambda: shared.value, RANK_DECIMALS, visit)

    return with_similarity(top_vectors(queries, k, scan_block, held.rdd.getNumPartitions()))


def with_similarity(ranked: DataFrame) -> DataFrame:
    key: Column = F.col("rank_key")
    similarity = (
        F.when(key == NULL_KEY, F.lit(None).cast("double"))
        .when(key == NAN_KEY, F.lit(float("nan")))
        .otherwise(1 - key)
    )
    return ranked.select("query_id", "rank", F.col("item_id").alias("id"), similarity.alias("similarity"))


def match_chunks_batch(
    kb: KnowledgeBase,
    queries: DataFrame,
    match_count: int = DEFAULT_MATCHES,
    filter: dict | None = None,
) -> DataFrame:
    """``match_chunks`` for a table ``queries(query_id, vector)``."""
    chunks = _in_tools(kb.page_chunk.select("id", "page_id", "embedding"), kb, filter)
    # The hits are a written table: Spark knows its size and chooses the joins by it.
    hits = nearest(chunks, queries, match_count)
    return _described(kb, hits, ["query_id", "rank"])


def search_text(
    kb: KnowledgeBase,
    questions: DataFrame,
    memo: DataFrame,
    match_count: int = DEFAULT_MATCHES,
    filter: dict | None = None,
    vectors: Callable[[DataFrame], DataFrame] | None = None,
    model: str = "native",
    width: int = VECTOR_WIDTH,
) -> tuple[DataFrame, Memoised]:
    """Matches of ``questions(query_id, query)`` as ``(query_id, rank, *RESULT_COLUMNS)``, and the calls made.

    Question texts are embedded as chunks are, through the memo of vectors:
    a question that was asked before, or twice at once, costs no second call.
    """
    keyed = questions.select(
        "query_id", F.col("query").alias("content"), vector_key(F.col("query"), model).alias("memo_key")
    )
    embedded = memoised(
        keyed, memo, ["content"], vectors or native_vectors(width), "embedding", F.col("failed")
    )
    asked = cut_lineage(embedded.rows.select("query_id", F.col("embedding").alias("vector")))
    matches = match_chunks_batch(kb, asked, match_count, filter)
    return search_result(matches, "query_id", "rank"), embedded


def context_pack(matches: DataFrame) -> DataFrame:
    """Per query, the matches in order as one text and their distinct source links.

    ``matches(query_id, rank, url, title, content)``; a query has at most as
    many rows as were asked for.
    """
    packed = matches.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "url", "title", "content"))).alias("m")
    )
    section = F.transform(
        "m", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n"), x["url"], F.lit("\n\n"), x["content"])
    )
    return packed.select(
        "query_id",
        F.array_join(section, "\n\n").alias("content"),
        F.array_distinct(F.transform("m", lambda x: x["url"])).alias("reference_urls"),
    )
