"""URL filters: rules by host and path, and a list of URLs behind a Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import bloom
from docloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that say where a visitor came from, not which page it is.
TRACKING = r"(^|&)(utm_[a-z]+|ref)=[^&]*"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parse_rule(line: str) -> Rule:
    """``block example.com/de/`` → verdict, host, path (from the first slash on)."""
    verdict, rule = line.split()
    host, slash, path = rule.partition("/")
    return Rule(verdict, host, slash + path)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host, path without closing slashes, query without tracking; null for a URL without ``://``.

    Scheme and fragment make no difference.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    tail = F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))
    whole = F.concat(url_host(url), F.regexp_replace(url_path(url), "/+$", ""), tail)
    return F.when(F.contains(url, F.lit("://")), whole)


def rule_column(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does.

    A rule fits its host and all subdomains if the path starts with the
    rule's. Of two rules of one length, the smaller by code point wins. Rules
    become one expression, so they should be hundreds at most; long lists
    belong in the list of URLs.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path), reverse=True):
        inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fits = inside & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.host + rule.path)).otherwise(found)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return found, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_column: str = "page_id") -> DataFrame:
    """Verdict of every row of ``pages`` (id, url): its rule's, else block if ``listed`` (url) holds it.

    A blocked Bloom filter of the canonical listed URLs passes possible hits to
    an exact hash join, which removes its false positives. Rows that the filter
    refuses are allowed without being moved.

    A null URL, or one without ``://``, has empty host and path, fits no rule,
    is on no list and is allowed; null and broken list entries are left out. Repeated rows
    and repeated list entries give one row per row of ``pages``. Other columns
    are left out, whatever their names.
    """
    keys = cut_lineage(
        listed.select(canonical_url(F.col("url")).alias("_listed")).where(F.col("_listed").isNotNull()).distinct()
    )
    found, verdict = rule_column(F.col("host"), F.col("path"), rules)
    parts = pages.select(
        F.col(id_column),
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        canonical_url(F.col("url")).alias("_key"),
    )
    ruled = parts.withColumn("rule", found).withColumn("_verdict", verdict)
    flagged = bloom.build(keys, "_listed").flag(ruled, F.col("_key"), "_maybe")
    columns = [id_column, "host", "path", "rule"]
    sure = flagged.where(~F.col("_maybe")).select(*columns, F.coalesce("_verdict", F.lit("allow")).alias("verdict"))
    hits = flagged.where(F.col("_maybe")).join(keys, F.col("_key") == F.col("_listed"), "left")
    checked = F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")
    return sure.unionByName(hits.select(*columns, F.coalesce("_verdict", checked).alias("verdict")))
