"""Search that SQL can call: a table-valued function over a knowledge base."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from docloom.functions.vectors import RANK_DECIMALS
from docloom.operators.search import DEFAULT_MATCHES, KnowledgeBase

_SQUARES = "sqrt(aggregate({0}, 0D, (total, x) -> total + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (total, p) -> total + p)"


def register_search(spark: SparkSession, kb: KnowledgeBase, name: str = "match_chunks") -> str:
    """Make ``name(query_embedding, match_count, filter)`` a temporary function of the session; returns its name.

    ``query_embedding`` is an ``ARRAY<FLOAT>``; ``match_count`` may be left out, as may
    ``filter``, a ``MAP<STRING, STRING>`` of text members that a tool's metadata must have.
    The function gives the columns of ``match_chunks``. Its body is one query:
    Spark turns the row numbers that it asks for into a top-k of the scan, since
    the count is a constant of each call. Numbers come first, then NaN, then
    NULL; vectors of another width than the query's are an error.
    """
    prefix = f"{name}_{uuid.uuid4().hex[:8]}"
    for table in ("tool_docs", "page", "page_chunk"):
        getattr(kb, table).createOrReplaceTempView(f"{prefix}_{table}")
    query, vector = f"{name}.query_embedding", "c.embedding"
    norms = f"{_SQUARES.format(vector)} * {_SQUARES.format(query)}"
    cosine = f"greatest(-1D, least(1D, {_DOT.format(vector, query)} / ({norms})))"
    distance = f"""
        CASE WHEN {vector} IS NULL OR {query} IS NULL THEN NULL
             WHEN size({vector}) <> size({query})
             THEN raise_error(concat('different vector dimensions ', size({vector}), ' and ', size({query})))
             WHEN {norms} = 0 THEN double('NaN')
             ELSE round(1 - {cosine}, {RANK_DECIMALS}) END"""
    members = "from_json(metadata, 'map<string,string>')"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(
            query_embedding ARRAY<FLOAT>, match_count INT DEFAULT {DEFAULT_MATCHES},
            filter MAP<STRING, STRING> DEFAULT CAST(map() AS MAP<STRING, STRING>))
        RETURNS TABLE (
            id BIGINT, url STRING, tool_name STRING, source_type STRING, chunk_number INT,
            title STRING, summary STRING, content STRING, metadata STRING, similarity DOUBLE)
        RETURN
        WITH tool AS (
            SELECT id, tool_name, source_type FROM {prefix}_tool_docs
            WHERE forall(map_entries({name}.filter), e -> coalesce(element_at({members}, e.key) = e.value, false))),
        held AS (
            SELECT p.id, p.url, t.tool_name, t.source_type FROM {prefix}_page p JOIN tool t ON t.id = p.tool_id),
        near AS (
            SELECT id, distance FROM (
                SELECT id, distance, row_number() OVER (ORDER BY distance ASC NULLS LAST, id) AS place
                FROM (SELECT c.id, {distance} AS distance FROM {prefix}_page_chunk c LEFT SEMI JOIN held ON held.id = c.page_id))
            WHERE place <= {name}.match_count)
        SELECT c.id, h.url, h.tool_name, h.source_type, c.chunk_number, c.title, c.summary, c.content, c.metadata,
               1 - n.distance
        FROM near n JOIN {prefix}_page_chunk c ON c.id = n.id JOIN held h ON h.id = c.page_id""")
    return name
