"""From package records and captured pages to the stored documentation of each package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.urls import url_netloc
from docloom.operators.enrichment import capture_key, memo_hits
from docloom.operators.ranking import number_rows
from docloom.operators.traversal import crawl
from docloom.plans.ingest import Ingested, ingest_documents
from docloom.schema import SOURCE_TYPE
from docloom.session import cut_lineage
from docloom.sources.captures import documents_of, scan_captures
from docloom.sources.kb_store import KnowledgeStore
from docloom.sources.registry import SETTING_NAMES, crawl_settings, resolve_documentation, split_resolved


def captured(store: KnowledgeStore, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """``(url, final_url, content, links)`` of ``pages(url, html)``; a URL seen before keeps its first capture.

    Only pages that the capture memo lacks are read as HTML, and are then
    remembered. With a column ``cached``, rows where it is false are read anew
    each time, and the memo is left alone.
    """
    flag = F.col("cached") if "cached" in pages.columns else F.lit(True)
    keyed = cut_lineage(pages.select("url", "html", capture_key(F.col("url")).alias("memo_key"), flag.alias("cached")))
    hits = cut_lineage(memo_hits(keyed.where("cached").select("memo_key"), store.memo("capture")).drop("memo_key"))
    fresh = keyed.join(hits.select("url", F.lit(True).alias("cached")), ["url", "cached"], "left_anti")
    scanned = cut_lineage(scan_captures(fresh.select("url", "html", "cached"), redirects))
    lasting = scanned.where("cached").drop("cached")
    store.remember("capture", lasting.select(capture_key(F.col("url")).alias("memo_key"), "*"))
    return hits.unionByName(scanned.drop("cached"))


def ingest_package_pages(
    store: KnowledgeStore,
    packages: DataFrame,
    pages: DataFrame,
    redirects: DataFrame,
    rules: DataFrame,
    as_of: Column,
    **options,
) -> tuple[Ingested, DataFrame]:
    """:func:`ingest_packages` over ``pages(url, html)`` as they are now, by way of the capture memo.

    Pages on the host of a package with ``caching_enabled`` false are read anew and not
    remembered; of packages that share a host, one is enough. Null is true.
    """
    named = resolve_documentation(packages).join(packages.select("package", "caching_enabled"), "package")
    off = named.where(~F.coalesce("caching_enabled", F.lit(True))).select(
        url_netloc(F.col("documentation_url")).alias("host"), F.lit(False).alias("cached")
    )
    flagged = pages.withColumn("host", url_netloc(F.col("url"))).join(off.distinct(), "host", "left")
    held = flagged.select("url", "html", F.coalesce("cached", F.lit(True)).alias("cached"))
    return ingest_packages(store, packages, captured(store, held, redirects), rules, as_of, **options)


def _crawled(starts: DataFrame, captures: DataFrame, rules: DataFrame) -> DataFrame:
    """``(crawl_id, url, depth)`` of crawls with bounds of their own, which run together."""
    links = captures.select("url", F.posexplode("links").alias("link_pos", "link")).select(
        "url", "link_pos", F.col("link.href").alias("href")
    )
    return crawl(starts, captures, links, rules)


def ingest_packages(
    store: KnowledgeStore,
    packages: DataFrame,
    captures: DataFrame,
    rules: DataFrame,
    as_of: Column,
    **options,
) -> tuple[Ingested, DataFrame]:
    """Store the documentation of ``packages``; also the packages that name none.

    ``packages(package, version, record, depth, strategy, ignore_robots, limit,
    caching_enabled)``: a registry record and the settings of its crawl; depth 0
    is the start page alone, limit 0 stores no page, null is no bound.
    ``captures(url, final_url, content, links)``, as :func:`captured` gives them. A package becomes a tool with its settings as
    metadata, even if no page of it was captured; its pages are those a crawl
    from its documentation URL stores.
    """
    settings = packages.select("package", *SETTING_NAMES)
    resolved, errors = split_resolved(cut_lineage(resolve_documentation(packages)))
    tools = cut_lineage(
        number_rows(resolved.select("package", "documentation_url"), "crawl_id", ["package"]).join(settings, "package")
    )
    described = tools.select(
        "crawl_id", F.col("package").alias("tool_name"), F.lit(SOURCE_TYPE).alias("source_type"),
        F.col("documentation_url").alias("tool_url"), crawl_settings().alias("tool_metadata"),
    )
    stored = described.select(
        "tool_name", "source_type", F.col("tool_url").alias("url"),
        F.col("tool_metadata").alias("metadata"), F.lit(1).alias("seq"),
    )
    store.upsert("tool_docs", stored, as_of)
    held = cut_lineage(captures)
    starts = tools.select(
        "crawl_id", F.col("documentation_url").alias("start_url"), "depth", "limit",
        F.coalesce("ignore_robots", F.lit(False)).alias("ignore_robots"),
    )
    found = cut_lineage(_crawled(starts, held, rules))
    # Several requests may end at one page: its own address goes before others.
    texts = documents_of(held)
    documents = found.join(texts, "url").join(described, "crawl_id").select(
        "tool_name", "source_type", "tool_url", "tool_metadata", "url", "content", F.lit(1).alias("seq")
    )
    return ingest_documents(store, documents, as_of, **options), errors
