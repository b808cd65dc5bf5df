"""URL expressions built on the generic URL pattern of RFC 3986, appendix B.

``parse_url`` is not used: it raises, or gives NULL, on the slightly broken
URLs that real pages contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.lets import let

URL_PATTERN = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"  # 1 scheme
    r"(?://([^/?#]*))?"  # 2 authority
    r"([^?#]*)"  # 3 path
    r"(?:\?([^#]*))?"  # 4 query
    r"(?:#(.*))?$"  # 5 fragment
)
_LEADING = "".join(map(chr, range(0x21)))


def _tidy(url: Column) -> Column:
    """Leading control characters and inner tabs or line ends are not part of a URL."""
    return F.translate(F.ltrim(url, F.lit(_LEADING)), "\t\r\n", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_tidy(url), URL_PATTERN, group)


def url_scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def url_netloc(url: Column) -> Column:
    """Authority with its case and port; empty for a relative URL."""
    return _part(url, 2)


def _full_path(url: Column) -> Column:
    return _part(url, 3)


def url_path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(_full_path(url), r";[^/]*$", "")


def url_query(url: Column) -> Column:
    return _part(url, 4)


def url_fragment(url: Column) -> Column:
    return _part(url, 5)


def url_to_filename(url: Column) -> Column:
    """Flat file name of a page: path, query and fragment; the host is not part of it."""
    raw = F.concat_ws("_", url_path(url), url_query(url), url_fragment(url))
    safe = F.trim(F.regexp_replace(raw, r"[^\p{L}\p{N}_\-]", "_"), F.lit("_"))
    return F.when(safe == "", "index").otherwise(safe)


def document_path(url: Column) -> Column:
    # The folder and the ending of document files.
    return F.concat(F.lit("data/docs/"), url_to_filename(url), F.lit(".md"))


def normalize_link(href: Column, requested_url: Column, final_url: Column) -> Column:
    """Link without fragment, with the requested URL replaced by the one it led to."""
    return F.replace(F.split_part(href, F.lit("#"), F.lit(1)), requested_url, final_url)


def url_join(base: Column, absolute_path: Column) -> Column:
    """A root-relative path on the site of ``base``."""
    return F.concat(url_scheme(base), F.lit("://"), url_netloc(base), absolute_path)


def robots_url(base: Column) -> Column:
    return url_join(base, F.lit("/robots.txt"))


def registry_url(package: Column, version: Column | None = None) -> Column:
    """Address of a package's registry record; a missing or empty version is left out."""
    # The registry's address and the form of its record paths.
    release = F.lit(None).cast("string") if version is None else F.nullif(version, F.lit(""))
    return F.concat_ws("/", F.lit("https://pypi.org/pypi"), package, release, F.lit("json"))


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def push(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(segment.isin("", "."), kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    def resolve(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), push)
        slash_end = F.element_at(segments, -1).isin("", ".", "..")
        return let(
            kept,
            lambda k: F.concat(
                F.lit("/"),
                F.array_join(k, "/"),
                F.when(slash_end & (F.size(k) > 0), "/").otherwise(""),
            ),
        )

    return let(F.split(path, "/"), resolve)


def _suffix(mark: str, value: Column) -> Column:
    return F.when(value == "", "").otherwise(F.concat(F.lit(mark), value))


def link_resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on the page ``base``."""
    path = _full_path(href)
    site = F.concat(url_scheme(base), F.lit("://"), url_netloc(base))
    tail = F.concat(_suffix("?", url_query(href)), _suffix("#", url_fragment(href)))
    folder = F.regexp_replace(_full_path(base), r"[^/]*$", "")
    return (
        F.when(url_scheme(href) != "", href)
        .when(F.startswith(href, F.lit("//")), F.concat(url_scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, _without_dots(path), tail))
        .when(href == "", base)
        .when(
            path == "",
            F.concat(
                site,
                _full_path(base),
                F.when(url_query(href) == "", _suffix("?", url_query(base))).otherwise(""),
                tail,
            ),
        )
        .otherwise(F.concat(site, _without_dots(F.concat(F.lit("/"), folder, path)), tail))
    )
