"""Page captures: pages keyed by the requested URL, with where the request ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.html import page_text
from docloom.operators.links import internal_links


def resolve_redirects(requests: DataFrame, redirects: DataFrame, url: str = "url") -> DataFrame:
    """Add ``final_url``: where a redirect leads, or the requested URL itself.

    ``redirects`` has one row per ``url`` and leads to final addresses.
    """
    hops = redirects.select(F.col("url").alias(url), F.col("final_url").alias("_hop"))
    return (
        requests.join(hops, url, "left")
        .withColumn("final_url", F.coalesce("_hop", url))
        .drop("_hop")
    )


def scan_captures(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """``(url, final_url, content, links)`` of every captured page, after its other columns.

    A page without HTML has NULL content and no links.
    """
    placed = resolve_redirects(pages, redirects)
    links = F.coalesce(
        internal_links(F.col("final_url"), F.col("html")),
        F.array().cast("array<struct<href:string,text:string>>"),
    )
    others = [c for c in pages.columns if c not in ("url", "html")]
    return placed.select(
        *others, "url", "final_url", page_text(F.col("html")).alias("content"), links.alias("links")
    )


# The names in a stored capture record.
LINK = "struct<href:string,text:string>"
CAPTURE_RECORD = (
    f"url string, final_url string, markdown_v2 struct<raw_markdown:string>, links struct<internal:array<{LINK}>>"
)


def read_capture_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures ``(url, final_url, content, links)`` of ``lines(value)``, a JSON record each; and the rejects.

    ``lines`` is what ``spark.read.text`` gives. Only the members of ``CAPTURE_RECORD``
    are read. A record without text has NULL content, one without internal links an
    empty list, one without a final address ended where it was requested.
    Rejects ``(line, reason)`` are lines that are no such record, or that name no URL;
    blank lines are neither. Nothing is dropped in silence, and no line ends the job.
    """
    schema = f"{CAPTURE_RECORD}, _broken string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    read = lines.where(F.trim("value") != "").select("value", F.from_json("value", schema, options).alias("r"))
    named = F.coalesce(F.col("r.url"), F.lit("")) != ""
    reason = F.when(F.col("r").isNull() | F.col("r._broken").isNotNull(), "broken record").when(~named, "no URL")
    judged = read.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(
        F.col("r.url").alias("url"),
        F.coalesce(F.nullif(F.col("r.final_url"), F.lit("")), F.col("r.url")).alias("final_url"),
        F.col("r.markdown_v2.raw_markdown").alias("content"),
        F.coalesce(F.col("r.links.internal"), F.array().cast(f"array<{LINK}>")).alias("links"),
    )
    return good, judged.where(F.col("reason").isNotNull()).select(F.col("value").alias("line"), "reason")


def with_content(captures: DataFrame) -> DataFrame:
    """Pages without text are neither stored, counted nor expanded."""
    return captures.where(F.length("content") > 0)


def documents_of(captures: DataFrame) -> DataFrame:
    """``(url, content)`` documents under their final URLs, one each.

    Of several requests that ended at one page, the page's own address goes
    before others, then the smallest.
    """
    order = F.struct((F.col("url") != F.col("final_url")).alias("other"), "url")
    best = with_content(captures).groupBy("final_url").agg(F.min_by("content", order).alias("content"))
    return best.select(F.col("final_url").alias("url"), "content")
