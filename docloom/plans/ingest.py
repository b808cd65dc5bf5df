"""From captured pages to the stored knowledge base, one batch at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.catalog import priced
from docloom.operators.chunking import DEFAULT_SIZE, chunk_documents
from docloom.operators.enrichment import enrich, enrich_memoised, native_titles
from docloom.operators.ranking import last_wins
from docloom.operators.upsert import flaws
from docloom.schema import VECTOR_WIDTH
from docloom.session import cut_lineage
from docloom.sources.kb_store import KnowledgeStore


USAGE = "kind string, cost double, tokens int"


@dataclass
class Ingested:
    """What one batch did: chunks written, chunks rejected, calls made."""

    chunks: DataFrame
    rejects: DataFrame
    usage: DataFrame


def ingest_documents(
    store: KnowledgeStore,
    documents: DataFrame,
    as_of: Column,
    size: int = DEFAULT_SIZE,
    width: int = VECTOR_WIDTH,
    titles: Callable[[DataFrame], DataFrame] | None = None,
    vectors: Callable[[DataFrame], DataFrame] | None = None,
    title_model: str = "native",
    vector_model: str = "native",
    prices: DataFrame | None = None,
) -> Ingested:
    """Upsert tools, pages and chunks of ``documents``.

    ``documents(tool_name, source_type, tool_url, tool_metadata, url, content,
    seq)``; of several texts of one page the greatest ``seq`` wins. Running a
    batch again changes nothing but ``updated_at``.

    Titles and vectors are native unless hooks are given. Native ones cost less
    than looking them up and are no calls, so they are not memoised. ``prices(model,
    cost_per_token)`` puts a cost on each call in ``usage``.
    """
    key = ["tool_name", "source_type", "tool_url"]
    latest = cut_lineage(
        last_wins(documents.where(F.length("content") > 0), [*key, "url"], "seq")
    )
    tools = latest.select(
        "tool_name", "source_type", F.col("tool_url").alias("url"),
        F.col("tool_metadata").alias("metadata"), "seq",
    )
    known = store.upsert("tool_docs", tools, as_of).select(
        F.col("id").alias("tool_id"), "tool_name", "source_type", F.col("url").alias("tool_url")
    )
    # Ids are found on keys; texts are moved once, to the id of their page.
    keyed = cut_lineage(latest.select(*key, "url", "seq").join(known, key))
    pages = store.upsert("page", keyed.select("tool_id", "url", "seq"), as_of, unique=True)
    ids = keyed.join(pages.select("tool_id", "url", F.col("id").alias("page_id")), ["tool_id", "url"])
    texts = latest.join(ids.select(*key, "url", "page_id"), [*key, "url"])
    chunks = cut_lineage(chunk_documents(texts.select("page_id", "url", "seq", "content"), "content", size))
    if titles is None and vectors is None:
        records = enrich(chunks, as_of, width)
        usage = store.spark.createDataFrame([], USAGE)
    else:
        records, titled, embedded = enrich_memoised(
            chunks, as_of, store.memo("title"), store.memo("vector"),
            titles or native_titles, vectors, title_model, vector_model, width,
        )
        store.remember("title", titled.additions)
        store.remember("vector", embedded.additions)
        calls = titled.usage.withColumn("model", F.lit(title_model)).unionByName(
            embedded.usage.withColumn("model", F.lit(vector_model))
        )
        usage = (calls if prices is None else priced(calls.drop("cost"), prices)).select("kind", "cost", "tokens")
    # The pages were stored just now, so only the chunks themselves can be at fault.
    judged = cut_lineage(flaws(records, width))
    sound, rejects = judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())
    return Ingested(store.upsert("page_chunk", sound, as_of, unique=True), rejects, usage)
