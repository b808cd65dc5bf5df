from __future__ import annotations

import re
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from docloom.functions import urls

URLS = [
    "https://docs.example.com/a/b.html?x=1&y=2#frag", "http://Example.COM:8080/p;v=1/q;z=2?k#", "//cdn.x/y",
    "/rooted/path", "relative/path", "", "mailto:a@b.c", "https://h", "https://h?q=1", "https://u:p@h/x",
    "https://h/a b/ü?é=1", "ftp://h/;p", "https://h/a;b/c", "1http://x/y", " https://lead.ing/x", "#only",
    "https://h/docs/page?with=params#fragment", "https://h/docs/page", "https://h/__", "https://h/a.b/c-d_e",
]


def test_parts_are_those_of_urlparse(spark):
    u = F.col("u")
    df = spark.createDataFrame([(x,) for x in URLS], "u string").select(
        "u", urls.url_scheme(u), urls.url_netloc(u), urls.url_path(u), urls.url_query(u), urls.url_fragment(u)
    )
    for row in df.collect():
        p = urlparse(row["u"])
        assert tuple(row)[1:] == (p.scheme, p.netloc, p.path, p.query, p.fragment), row["u"]


def test_file_names(spark):
    df = spark.createDataFrame([(x,) for x in URLS], "u string")
    for url, name in df.select("u", urls.url_to_filename(F.col("u"))).collect():
        p = urlparse(url)
        wanted = re.sub(r"[^\w-]", "_", f"{p.path}_{p.query}_{p.fragment}").strip("_") or "index"
        assert name == wanted


def test_known_file_paths(spark):
    df = spark.createDataFrame(
        [("https://x.org/docs/page",), ("https://x.org/docs/page?with=params#fragment",)], "u string"
    )
    got = [r[0] for r in df.select(urls.document_path(F.col("u"))).collect()]
    assert got == ["data/docs/docs_page.md", "data/docs/docs_page_with_params_fragment.md"]


def test_resolution_is_that_of_urljoin(spark):
    bases = ["https://h.org/a/b/c.html?q=1", "http://h.org", "https://h.org/dir/"]
    hrefs = [
        "x", "./x", "../x", "../../x", "../../../x", "/x/../y", "/x/./y/", "?n=1", "#f", "", "//o.org/z", "y/..",
        "https://o.org/a/../b", "x?k=v#f", "/", ".", "..", "a/b/../../c/", "mailto:a@b.c",
    ]
    pairs = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(pairs, "b string, h string")
    for base, href, got in df.select("b", "h", urls.link_resolve(F.col("b"), F.col("h"))).collect():
        assert got.rstrip("/") == urljoin(base, href).rstrip("/"), (base, href)


def test_normalised_links(spark):
    rows = [
        ("https://h/a#sec", "https://h/a", "https://h/b", "https://h/b"),
        ("https://h/x#", "https://h/a", "https://h/b", "https://h/x"),
        ("#top", "https://h/a", "https://h/b", ""),
    ]
    df = spark.createDataFrame(rows, "href string, req string, fin string, want string")
    got = df.select(urls.normalize_link(F.col("href"), F.col("req"), F.col("fin")), "want").collect()
    assert all(a == b for a, b in got)


def test_registry_and_robots_addresses(spark):
    df = spark.createDataFrame([("p", None), ("p", ""), ("p", "1.2")], "p string, v string")
    got = [r[0] for r in df.select(urls.registry_url(F.col("p"), F.col("v"))).collect()]
    assert got == ["https://pypi.org/pypi/p/json"] * 2 + ["https://pypi.org/pypi/p/1.2/json"]
    one = spark.createDataFrame([("https://h:1/a/b?c",)], "u string")
    assert one.select(urls.robots_url(F.col("u"))).first()[0] == "https://h:1/robots.txt"
