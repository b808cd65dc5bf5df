"""Link tables of captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.html import anchors
from docloom.functions.urls import link_resolve, normalize_link, url_netloc


def page_links(pages: DataFrame) -> DataFrame:
    """One row per anchor: the page's columns but its HTML, with position, href and text."""
    others = [c for c in pages.columns if c != "html"]
    return pages.select(*others, F.posexplode(anchors(F.col("html"))).alias("link_pos", "link")).select(
        *others, "link_pos", F.col("link.href").alias("href"), F.col("link.text").alias("text")
    )


def classify_links(links: DataFrame, base: str = "url") -> DataFrame:
    """Absolute target and whether it stays on the page's own host."""
    resolved = links.withColumn("target", link_resolve(F.col(base), F.col("href")))
    same = url_netloc(F.col("target")) == url_netloc(F.col(base))
    return resolved.withColumn("link_class", F.when(same, "internal").otherwise("external"))


def internal_links(base: Column, html: Column) -> Column:
    """Internal targets of one page in order, as ``ARRAY<STRUCT<href, text>>``."""
    resolved = F.transform(
        anchors(html),
        lambda a: F.struct(link_resolve(base, a["href"]).alias("href"), a["text"].alias("text")),
    )
    return F.filter(resolved, lambda a: url_netloc(a["href"]) == url_netloc(base))


def queue_links(links: DataFrame) -> DataFrame:
    """Links in queueing form: normalised, empty ones dropped, first position of each kept.

    ``links`` has ``url`` (as requested), ``final_url``, ``link_pos``, ``href``.
    The minimum is taken before the exchange, so a target that every page
    links to costs one row per source page.
    """
    target = normalize_link(F.col("href"), F.col("url"), F.col("final_url"))
    return (
        links.where(F.col("href") != "")
        .select("url", "link_pos", target.alias("target"))
        .where(F.col("target") != "")
        .groupBy("url", "target")
        .agg(F.min("link_pos").alias("link_pos"))
    )
