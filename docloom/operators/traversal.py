"""Breadth-first link traversal over captured pages, for many crawls at once.

The order a sequential queue would visit pages in is kept as data: every
request carries the positions of the links that led to it, and arrays compare
lexicographically. One level of all crawls is one set of joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.urls import url_netloc
from docloom.operators.links import queue_links
from docloom.operators.ranking import number_rows
from docloom.operators.robots import allowed
from docloom.session import cut_lineage


def in_scope(urls: DataFrame, base_url: str = "start_url") -> DataFrame:
    """Requests whose address, before and after redirects, is on the start page's host."""
    base = url_netloc(F.col(base_url))
    return urls.where((url_netloc(F.col("url")) == base) & (url_netloc(F.col("final_url")) == base))


# A crawl's own bounds; each of its requests carries them along.
BOUNDS = "struct<depth:long,limit:long,ignore_robots:boolean>"


def _bounded(starts: DataFrame, depth: int | None, limit: int | None) -> DataFrame:
    """Starts with ``bounds``: their own columns where they have them, those given for all otherwise."""

    def own(name: str, usual: int | bool | None, kind: str) -> Column:
        given = F.lit(usual).cast(kind)
        return (F.coalesce(F.col(name).cast(kind), given) if name in starts.columns else given).alias(name)

    bounds = F.struct(own("depth", depth, "long"), own("limit", limit, "long"), own("ignore_robots", False, "boolean"))
    return starts.select("crawl_id", "start_url", bounds.cast(BOUNDS).alias("bounds"))


def _fetchable(captures: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Captured pages that a crawl of their own host would store, and whether robots rules allow them."""
    pages = captures.where(
        (F.length("content") > 0) & (url_netloc(F.col("url")) == url_netloc(F.col("final_url")))
    ).select("url", "final_url")
    return pages.withColumn("allowed", F.lit(True)) if rules is None else allowed(pages, rules)


def _may(allowed_: str) -> Column:
    return F.col("bounds.ignore_robots") | F.col(allowed_)


def crawl(
    starts: DataFrame,
    captures: DataFrame,
    links: DataFrame,
    rules: DataFrame | None = None,
    depth: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``(crawl_id, url, depth)``: final URLs that each crawl stores.

    ``starts(crawl_id, start_url)``; ``captures(url, final_url, content)`` with
    one row per requested URL, where a final URL redirects no further;
    ``links(url, link_pos, href)``. ``depth`` 0 keeps to the start page,
    ``limit`` counts final URLs in visit order, and 0 stores none; ``None`` means
    no bound. ``starts`` may have columns ``depth``, ``limit`` and ``ignore_robots``:
    bounds of that crawl alone, where they are not null. Crawls of all bounds
    share one frontier, so the number of jobs is that of the deepest one.
    """
    return _traverse(starts, captures, links, rules, depth, limit)[0]


def links_per_page(
    starts: DataFrame,
    captures: DataFrame,
    links: DataFrame,
    rules: DataFrame | None = None,
    depth: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``(crawl_id, url, new_links)``: requests that each page added to its crawl, as its first finder.

    Arguments are those of :func:`crawl`; pages that added none are left out.
    """
    requests = _traverse(starts, captures, links, rules, depth, limit)[1]
    return requests.groupBy("crawl_id", F.col("via").alias("url")).agg(F.count("*").alias("new_links"))


def _traverse(
    starts: DataFrame,
    captures: DataFrame,
    links: DataFrame,
    rules: DataFrame | None,
    depth: int | None,
    limit: int | None,
) -> tuple[DataFrame, DataFrame]:
    """Pages that are stored, and the requests with the page that each was first found on."""
    bounded = cut_lineage(_bounded(starts, depth, limit))
    limited = not bounded.where("bounds.limit IS NOT NULL").isEmpty()
    pages = cut_lineage(_fetchable(captures, rules))
    targets = pages.select(
        F.col("url").alias("target"), F.col("final_url").alias("target_final"), F.col("allowed").alias("target_allowed")
    )
    edges = cut_lineage(
        queue_links(links.join(pages.drop("allowed"), "url"))
        .join(targets, "target")
        # Every stored page is on its crawl's host, so scope is known per edge.
        .where(url_netloc(F.col("url")) == url_netloc(F.col("target")))
    )
    level = bounded.join(pages, bounded["start_url"] == pages["url"]).where(_may("allowed")).select(
        "crawl_id", "url", "final_url", F.array().cast("array<int>").alias("path"),
        F.lit(None).cast("string").alias("via"), "bounds",
    )
    level = cut_lineage(_marked(level, [], limited))
    requested = [level.select("crawl_id", "url", "via")]
    stored = [_stored(level, 0)]
    reached = 0
    while True:
        reached += 1
        deeper = level.where(F.coalesce(F.col("bounds.depth") >= reached, F.lit(True)))
        growing = _unfinished(deeper, stored) if limited else deeper
        found = _next_level(growing, edges, requested, stored)
        level = cut_lineage(_marked(found, stored, limited))
        if level.isEmpty():
            break
        requested = _compact([*requested, level.select("crawl_id", "url", "via")])
        stored = _compact([*stored, _stored(level, reached)])
    found = _all(requested).where(F.col("via").isNotNull())
    return _all(stored).select("crawl_id", F.col("final_url").alias("url"), "depth"), found


def _stored(level: DataFrame, depth: int) -> DataFrame:
    return level.where("stores").select("crawl_id", "final_url", F.lit(depth).alias("depth"))


def _marked(level: DataFrame, stored: list[DataFrame], limited: bool) -> DataFrame:
    """Add ``stores``: whether a request is the first to reach a page its crawl stores.

    A page is not requested at all once a redirect of its own level led to it.
    """
    first = level.groupBy("crawl_id", "final_url").agg(
        F.min("path").alias("_first"), F.any_value("bounds.limit").alias("_limit")
    )
    fresh = first
    if stored:
        fresh = fresh.join(_all(stored), ["crawl_id", "final_url"], "left_anti")
    if limited:
        fresh = _within_limit(fresh, stored)
    fresh = fresh.select("crawl_id", "final_url", F.lit(True).alias("_fresh"))
    marks = first.join(fresh, ["crawl_id", "final_url"], "left")
    is_first = F.col("path") == F.col("_first")
    return (
        level.join(marks, ["crawl_id", "final_url"])
        .where((F.col("url") != F.col("final_url")) | is_first)
        .withColumn("stores", is_first & F.coalesce("_fresh", F.lit(False)))
        .select("crawl_id", "url", "final_url", "path", "via", "bounds", "stores")
    )


def _compact(levels: list[DataFrame]) -> list[DataFrame]:
    """Many levels written as one, so that a deep crawl keeps a short plan."""
    return levels if len(levels) < 20 else [cut_lineage(_all(levels))]


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _next_level(
    level: DataFrame, edges: DataFrame, requested: list[DataFrame], stored: list[DataFrame]
) -> DataFrame:
    """Requests found on this level that were never made before, by first discovery."""
    made = _all(requested).select("crawl_id", "url")
    known = _all(stored).select("crawl_id", F.col("final_url").alias("url"))
    return (
        level.join(edges, "url")
        .where(_may("target_allowed"))
        .select(
            "crawl_id",
            "bounds",
            F.col("final_url").alias("via"),
            F.col("target").alias("url"),
            F.col("target_final").alias("final_url"),
            F.concat("path", F.array("link_pos")).alias("path"),
        )
        .groupBy("crawl_id", "url")
        .agg(
            F.min("path").alias("path"), F.any_value("final_url").alias("final_url"),
            F.min_by("via", "path").alias("via"), F.any_value("bounds").alias("bounds"),
        )
        .join(made.unionByName(known), ["crawl_id", "url"], "left_anti")
    )


def _counts(stored: list[DataFrame]) -> DataFrame:
    return _all(stored).groupBy("crawl_id").agg(F.count("*").alias("_stored"))


def _within_limit(fresh: DataFrame, stored: list[DataFrame]) -> DataFrame:
    """The first pages of a level, in visit order, that each crawl's limit still admits."""
    numbered = number_rows(fresh.where("_limit IS NOT NULL"), "_place", ["_first"], within=["crawl_id"])
    if stored:
        numbered = numbered.join(_counts(stored), "crawl_id", "left")
    else:
        numbered = numbered.withColumn("_stored", F.lit(0))
    admitted = numbered.where(F.col("_place") + F.coalesce("_stored", F.lit(0)) <= F.col("_limit"))
    return admitted.select(*fresh.columns).unionByName(fresh.where("_limit IS NULL"))


def _unfinished(level: DataFrame, stored: list[DataFrame]) -> DataFrame:
    """Rows of crawls that have not reached their limit."""
    full = F.coalesce("_stored", F.lit(0)) >= F.col("bounds.limit")
    return level.join(_counts(stored), "crawl_id", "left").where(~F.coalesce(full, F.lit(False))).drop("_stored")
