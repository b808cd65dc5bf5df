"""Reading of HTML: tokens against the standard library's parser, odd and hostile markup, metadata."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from docloom.functions import html as page


def rows(spark, texts, *makers):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, h string")
    return [tuple(r) for r in df.select("n", *[m(F.col("h")) for m in makers]).orderBy("n").collect()]


class Plain(HTMLParser):
    """Text and links as the standard library's parser finds them; no block tags are used here."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.open, self.skipped = [], [], False, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skipped = tag
        elif tag == "a":
            href = next((v or "" for k, v in attrs if k == "href"), None)
            self.open = href is not None
            if self.open:
                self.links.append([href, ""])

    def handle_endtag(self, tag):
        if tag == self.skipped:
            self.skipped = None
        elif tag == "a":
            self.open = False

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)
            if self.open:
                self.links[-1][1] += data


PIECES = [
    "some words", " and ", "1 < 2", " a<b ", "<>", "x > y", "&amp;", "&lt;b&gt;", "&copy B", "&#65;", "&#x42", "&#128;", "&notit;", "&nosuch;",
    '<b title="a > b">', "</b>", "<i class='>'>", "</i>", "<span data-x=1 hidden>", "</span>", '<img alt="x>y">', "<img alt='\"'>",
    '<a href="/x?a=1&b=2">', "<a href=/y>", "<a title='>' href = '/z' >", "<a name=q>", "<A HREF='/&amp;'>", "</a>", "</a >",
    "<!-- c > <a href='/no'> -->", "<!---->", "<!doctype html>", "<?xml a?>", "<script>if (a<b) '<p>'</script>", "<style>p>a{}</style>",
    "<title>t <b> &lt;</title>", "<em\nid=1>", "</em>",
]


def test_equals_the_standard_parser(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randrange(1, 30))) for _ in range(400)]
    got = rows(spark, texts, page.page_text, page.anchors)
    for (_, text, links), markup in zip(got, texts, strict=True):
        plain = Plain()
        plain.feed(markup)
        plain.close()
        assert text.split() == "".join(plain.text).replace("\xa0", " ").split(), markup
        assert [(a["href"], a["text"].split()) for a in links] == [(h, t.split()) for h, t in plain.links], markup


def test_tokens_join_to_the_page(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(PIECES + ["<", "\"", "'", "<a href=\"", "<!--", "<pre>", "</pre>"]) for _ in range(30)) for _ in range(200)]
    for (_, joined), markup in zip(rows(spark, texts, lambda h: F.array_join(page.tokens(h), "")), texts, strict=True):
        assert joined == markup


def test_unseen_parts_nest(spark):
    texts = [
        "a<svg><svg>no</svg>no</svg>b", "a<template><template></template>no</template>b", "<head><title>t</title><body>b",
        "<noscript>no</noscript>b<svg/>c", "a<svg>never closed", "a<svg><template>no</svg>b", "<header>h</header>",
    ]
    assert [t for _, t in rows(spark, texts, page.page_text)] == ["ab", "ab", "b", "bc", "anever closed", "ab", "h"]


def test_side_parts_nest(spark):
    words = "eleven words of prose that stay unless a part hides them"
    texts = [
        f"<nav><nav><p>{words}</p></nav><p>{words}</p></nav><p>kept {words}</p>",
        f"<header><nav><p>{words}</p></header><p>kept {words}</p>",
        f"<p>kept {words}</p><footer><footer title='</footer>'><p>{words}</p></footer><p>{words}</p></footer>",
        f"<p>{words}</p><nav>never closed<p>{words}</p>",
    ]
    got = [t for _, t in rows(spark, texts, page.page_text_pruned)]
    assert got == [f"kept {words}", f"kept {words}", f"kept {words}", f"{words}\n\n{words}"]


def test_density_decides_by_the_page(spark):
    words = "eleven words that stand in the very same kind of block"
    marked = "".join(f"<span class='a-long-name-of-a-class style-{i}' data-number='{i}'>{w}</span> " for i, w in enumerate(words.split()))
    prose = f"<p>{'plain prose of some length fills this page. ' * 20}</p>"
    alone, beside, linked = rows(spark, [f"<div>{marked}</div>", f"{prose}<div>{marked}</div>", f"<p>{words} <a href='/'>{words} {words}</a></p>"], page.page_text_pruned)
    assert alone[1] == words  # all of the page is so thick with markup
    assert beside[1].startswith("plain prose") and words not in beside[1]
    assert linked[1] == ""


def test_code_that_is_never_closed_goes_to_the_end(spark):
    assert rows(spark, ["a<pre>b  c<p>d", "a<script>b</scripty>"], page.page_text) == [(0, "a\n\n```\nb  cd\n```"), (1, "a")]


@pytest.mark.parametrize(
    "hostile",
    ["<a " + "x=1 " * 100_000 + ">t</a>", "<" * 100_000, "<!--" * 50_000, "<pre>" * 10_000, "<script>" * 10_000, "<svg>" * 10_000,
     "<nav>" * 2000 + "z" + "</nav>" * 2000, "&" * 100_000, '<a title="' + "q" * 200_000, "<a href=x>" * 10_000, "<p " * 50_000],
    ids=lambda h: h[:8],
)
def test_hostile_pages_end(spark, hostile):
    ((_, text, pruned, links),) = rows(spark, [hostile], page.page_text, page.page_text_pruned, page.anchors)
    assert text is not None and pruned is not None and links is not None


def test_nothing_from_nothing(spark):
    makers = (page.page_text, page.page_text_pruned, page.page_title, page.anchors, page.page_meta)
    null, empty = rows(spark, [None, ""], *makers)
    assert null[3] is None and null[5] is None and empty[1:4] == ("", "", None)
    assert empty[4] == [] and empty[5]["meta"] == {} and empty[5]["language"] is None


def test_a_name_that_goes_on_in_an_attribute_is_no_reference(spark):
    markup = ["<a href='?a=1&copy=2&copyx&copy;&amp&lt;'>&copy=2&copyx</a>"]
    ((_, links),) = rows(spark, markup, page.anchors)
    assert [tuple(a) for a in links] == [("?a=1&copy=2&copyx©&<", "©=2©x")]


def test_metadata(spark):
    markup = """<html LANG=' de '><head><title>T &amp; t</title><meta charset="utf-8">
      <meta name="Description" content="a > b &quot;c&quot;"><meta name=description content=second>
      <meta property="og:title" content=""><meta name=empty><meta http-equiv=Refresh content=5>
      <link rel="stylesheet canonical" href="/c?a=1&b=2"><link rel=canonical href=/later></head>
      <svg><title>no</title><meta name=drawn content=no></svg>"""
    ((_, m),) = rows(spark, [markup], page.page_meta)
    assert (m["title"], m["language"], m["canonical"]) == ("T & t", "de", "/c?a=1&b=2")
    assert m["meta"] == {"description": 'a > b "c"', "og:title": "", "refresh": "5"}
    ((_, drawn),) = rows(spark, ["<svg><title>no</title></svg><title>yes</title><title>later</title>"], page.page_title)
    assert drawn == "yes"
