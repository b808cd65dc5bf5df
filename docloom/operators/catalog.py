"""Tool catalog, usage totals and crawl counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tool_catalog(tools: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages per tool, most first. A tool without pages counts 1: its own outer-joined row.

    Pages are counted before the join, so a tool with very many costs one row
    per task.
    """
    counted = pages.groupBy(F.col("tool_id").alias("id")).agg(F.count("*").alias("n"))
    return (
        tools.join(counted, "id", "left")
        .groupBy("tool_name", "source_type", "url")
        .agg(F.sum(F.coalesce("n", F.lit(1))).alias("page_count"))
        .orderBy(F.desc("page_count"), "tool_name", "source_type", "url")
    )


def catalog_line(catalog: DataFrame) -> DataFrame:
    """The catalog as one sentence, in catalog order: one row, so one task lists all tools.

    Fixed values: the wording of the line and of its entries.
    """
    entry = F.struct(
        (-F.col("page_count")).alias("order"),
        "tool_name",
        "source_type",
        "url",
        F.format_string(
            "%s (%s, %d pages from %s)", "tool_name", "source_type", "page_count", "url"
        ).alias("text"),
    )
    listed = F.array_join(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), ", "
    )
    return catalog.agg(F.concat(F.lit("Available tools: "), listed).alias("line"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Cost and tokens per kind of call, and in total."""
    return (
        usage.rollup("kind")
        .agg(F.sum("cost").alias("cost"), F.sum("tokens").cast("long").alias("tokens"))
        .withColumn("kind", F.coalesce("kind", F.lit("total")))
    )


def usage_summary(usage: DataFrame) -> DataFrame:
    """The eight-line report; a kind without calls counts zero."""

    def of(column: str, kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    totals = usage.agg(
        of("cost", "completion").cast("double").alias("cc"),
        of("cost", "embedding").cast("double").alias("ec"),
        of("tokens", "completion").cast("long").alias("ct"),
        of("tokens", "embedding").cast("long").alias("et"),
    )
    # The lines of the report.
    layout = (
        "=== Cost and Token Usage Summary ===\n"
        "Completion Cost: $%.6f\nEmbedding Cost: $%.6f\nTotal Cost: $%.6f\n"
        "\n"
        "Completion Tokens: %d\nEmbedding Tokens: %d\nTotal Tokens: %d"
    )
    cost, tokens = F.col("cc") + F.col("ec"), F.col("ct") + F.col("et")
    return totals.select(
        F.format_string(layout, "cc", "ec", cost, "ct", "et", tokens).alias("summary")
    )


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows from token counts and a price per token; ``prices(model, cost_per_token)``."""
    return calls.join(prices, "model", "left").withColumn(
        "cost", F.col("tokens") * F.coalesce("cost_per_token", F.lit(0.0))
    )


def chunks_per_page(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("url").agg(F.count("*").alias("n_chunks"))


def pages_per_depth(crawled: DataFrame) -> DataFrame:
    """Pages that each crawl stored, by depth."""
    return crawled.groupBy("crawl_id", "depth").agg(F.count("*").alias("n_pages"))
