"""Inputs of the registered queries, derived from the given tables.

The given tables have no links between held pages, no redirects, no robots
rules and no stored knowledge base; these are made from their rows by fixed
rules, over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.html import page_title
from docloom.functions.urls import url_netloc
from docloom.operators.chunking import chunk_documents
from docloom.operators.enrichment import chunk_metadata, extract_summary, extract_title
from docloom.operators.ranking import number_rows
from docloom.operators.search import KnowledgeBase
from docloom.schema import SOURCE_TYPE
from docloom.session import cut_lineage, spread
from docloom.sources.captures import resolve_redirects

AS_OF = "2025-01-01 00:00:00"
LATER = "2025-02-01 00:00:00"
WIDTH = 64
# Chunk ids leave this many numbers to each document. A text of 2^31 bytes, the most that a row can
# hold, has under 2^21 chunks, as each but the last has at least 1500 characters.
CHUNK_IDS = 1 << 21


def moment(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs far more per row than reading it."""
    return spread(table(spark, sf_dir, name))


# --- documents as pages of a tool per source ----------------------------------------------


def document_url() -> Column:
    return F.format_string("https://%s.example.org/%s/%d", "source", "lang", "doc_id")


def tool_url(name: str = "source") -> Column:
    return F.concat(F.lit("https://"), F.col(name), F.lit(".example.org/"))


def tool_settings() -> Column:
    """Tool metadata with a version that is text or JSON null, and a limit that may be absent."""
    version = (
        F.when(F.endswith(F.col("source"), F.lit("3")), '"version":null')
        .when(F.contains(F.col("source"), F.lit("1")), '"version":"2"')
        .otherwise('"version":"1"')
    )
    limit = F.when(F.endswith(F.col("source"), F.lit("5")), "").otherwise(',"limit":"100"')
    return F.concat(F.lit("{"), version, F.lit(',"strategy":"bfs"'), limit, F.lit("}"))


def source_number() -> Column:
    return F.substring("source", 4, 9).cast("long") + 1


def chunk_id() -> Column:
    return (F.col("doc_id") + 1) * CHUNK_IDS + F.col("chunk_number")


def kb_tools(documents: DataFrame) -> DataFrame:
    return (
        documents.select("source").distinct()
        .select(
            source_number().alias("id"), F.col("source").alias("tool_name"),
            F.lit(SOURCE_TYPE).alias("source_type"), tool_url().alias("url"),
            moment().alias("created_at"), moment().alias("updated_at"),
            tool_settings().alias("metadata"),
        )
    )


def kb_pages(documents: DataFrame) -> DataFrame:
    return documents.select(
        (F.col("doc_id") + 1).alias("id"), source_number().alias("tool_id"),
        document_url().alias("url"), moment().alias("created_at"), moment().alias("updated_at"),
    )


def kb_chunks(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunk 0 takes its document's vector, which is zeroed for Spanish texts; others have none."""
    vectors = embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    chunks = chunk_documents(
        documents.select("doc_id", "lang", document_url().alias("url"), "text"), "text"
    ).join(vectors, "doc_id", "left")
    vector = F.when(
        F.col("chunk_number") == 0,
        F.when(F.col("lang") == "es", F.transform("vector", lambda x: (x * 0).cast("float")))
        .otherwise(F.col("vector")),
    )
    content = F.col("content")
    return chunks.select(
        chunk_id().alias("id"),
        (F.col("doc_id") + 1).alias("page_id"), "chunk_number",
        extract_title(content).alias("title"), extract_summary(content).alias("summary"),
        "content", vector.alias("embedding"),
        chunk_metadata(F.col("url"), content, moment()).alias("metadata"),
        moment().alias("created_at"), moment().alias("updated_at"),
    )


def knowledge_base(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    documents = table(spark, sf_dir, "documents")
    return KnowledgeBase(
        kb_tools(documents),
        kb_pages(documents),
        kb_chunks(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )


# --- pages as a linked site per host ------------------------------------------------------


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html)`` by URL without fragment; the smaller id is kept."""
    return (
        texts(spark, sf_dir, "pages")
        .withColumn("url", F.split_part("url", F.lit("#"), F.lit(1)))
        .groupBy("url")
        .agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("page"))
        .select("page.page_id", "url", "page.html")
    )


FEED = "?utm_source=feed"


def redirects(held: DataFrame) -> DataFrame:
    return held.where(F.endswith("url", F.lit(FEED))).select(
        "url", F.replace("url", F.lit(FEED), F.lit("")).alias("final_url")
    )


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with redirect, content and place within their host, from 0.

    ``.html`` pages but the first of a host are empty.
    """
    held = captures(spark, sf_dir).select(
        "page_id", "url", url_netloc(F.col("url")).alias("host"), page_title(F.col("html")).alias("title")
    )
    placed = number_rows(held, "place", ["page_id"], within=["host"]).withColumn(
        "place", F.col("place") - 1
    )
    empty = F.endswith("url", F.lit(".html")) & (F.col("place") > 0)
    return resolve_redirects(placed, redirects(held)).withColumn(
        "content", F.when(empty, "").otherwise(F.col("title"))
    )


def site_links(pages: DataFrame) -> DataFrame:
    """Three children per page, then parent, nothing, first child with fragment, other host."""
    parent = F.floor((F.col("place") - 1) / 3)
    up = pages.where("place > 0").select(
        "host", parent.alias("parent"), ((F.col("place") - 1) % 3).cast("int").alias("link_pos"),
        F.col("url").alias("child"),
    )
    pairs = up.join(
        pages.select("host", F.col("place").alias("parent"), F.col("url").alias("parent_url")),
        ["host", "parent"],
    )

    def rows(df: DataFrame, url: str, pos: Column, href: Column) -> DataFrame:
        return df.select(F.col(url).alias("url"), pos.cast("int").alias("link_pos"), href.alias("href"))

    return (
        rows(pairs, "parent_url", F.col("link_pos"), F.col("child"))
        .unionByName(rows(pairs, "child", F.lit(3), F.col("parent_url")))
        .unionByName(rows(pages, "url", F.lit(4), F.lit("")))
        .unionByName(
            rows(
                pairs.where("link_pos = 0"), "parent_url", F.lit(5),
                F.concat("child", F.lit("#x")),
            )
        )
        .unionByName(rows(pages, "url", F.lit(6), F.lit("https://elsewhere.example/")))
    )


def site_rules(pages: DataFrame) -> DataFrame:
    """Robots rules by kind of host; most hosts have none."""
    rule = "struct<rule_no:int,agent:string,directive:string,path:string>"

    def rules(*items: tuple[str, str, str]) -> Column:
        made = [
            F.struct(
                F.lit(i).alias("rule_no"), F.lit(a).alias("agent"),
                F.lit(d).alias("directive"), F.lit(p).alias("path"),
            )
            for i, (a, d, p) in enumerate(items)
        ]
        return F.array(*made).cast(f"array<{rule}>")

    by_kind = (
        F.when(
            F.startswith("netloc", F.lit("www.")),
            rules(("*", "Disallow", "/de/"), ("*", "Allow", "/fr/"), ("*", "Disallow", "/fr")),
        )
        .when(F.startswith("netloc", F.lit("blog.")), rules(("*", "Disallow", ""), ("*", "Disallow", "/")))
        .when(
            F.startswith("netloc", F.lit("m.")),
            rules(("other", "Disallow", "/"), ("*", "Allow", "/en/"), ("*", "Disallow", "/")),
        )
    )
    hosts = pages.select(F.col("host").alias("netloc")).distinct()
    return hosts.select("netloc", F.explode(by_kind).alias("rule")).select("netloc", "rule.*")


def site_starts(pages: DataFrame) -> DataFrame:
    return pages.where("place = 0").select(
        F.col("page_id").alias("crawl_id"), F.col("url").alias("start_url"), "host"
    )


# --- upsert batches -----------------------------------------------------------------------


def batch_rows(documents: DataFrame, batch: int) -> DataFrame:
    """Documents of a batch with their tool, page and text.

    The first holds all but French texts, the second all but Spanish ones: so
    some rows stay, some change and some are new. The second has the German
    texts twice, the later time with a longer text.
    """
    rows = documents.select(
        F.concat_ws("-", "source", "lang").alias("tool_name"), F.lit(SOURCE_TYPE).alias("source_type"),
        tool_url().alias("tool_url"), document_url().alias("url"), "doc_id", "lang", "text",
        F.lit(batch).alias("seq"),
    )
    if batch == 1:
        return rows.where("lang <> 'fr'")
    rows = rows.where("lang <> 'es'")
    again = rows.where("lang = 'de'").select(
        *[c for c in rows.columns if c not in ("text", "seq")],
        F.concat("text", F.lit("\n\nAgain.")).alias("text"),
        F.lit(batch + 1).alias("seq"),
    )
    return rows.unionByName(again)


# --- questions ----------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, turn_id)``: turns numbered densely, however many a conversation has."""
    return number_rows(conversations.select("conv_id", "turn"), "turn_id", ["conv_id", "turn"])


def questions_and_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns are questions; an assistant's turn right after one is its accepted answer."""
    turns = conversations.join(cut_lineage(numbered_turns(conversations)), ["conv_id", "turn"])
    said = turns.where("role = 'assistant'")
    answers = said.select(F.col("turn_id").alias("answer_id"), F.col("text").alias("body"))
    asked = turns.where("role = 'user'").select(
        F.col("turn_id").alias("question_id"), "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("title")
    )
    accepted = said.select("conv_id", "turn", F.col("turn_id").alias("accepted_answer_id"))
    return asked.join(accepted, ["conv_id", "turn"], "left").drop("conv_id", "turn"), answers
