from __future__ import annotations

import html
import html.entities
import json

from pyspark.sql import functions as F

from docloom.functions import html as page
from docloom.functions.json import FALLBACK_SUMMARY, FALLBACK_TITLE, contains_metadata, reply_parse
from docloom.functions.text import prompt_excerpt, unfence
from docloom.sources.registry import crawl_settings, resolve_documentation, split_resolved


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "s string").select(build(F.col("s")).alias("x")).first()["x"]


def test_unfence(spark):
    cases = {
        "  plain \n": "plain",
        '```json\n{"a": 1}\n```': '{"a": 1}',
        'Here you are:\n```\n{"a": "```"}\n``` done': '{"a": "```"}',
        "```json\nno end": "no end",
        "```one line```": "one line",
        "a ```": "",
    }
    for reply, wanted in cases.items():
        assert one(spark, reply, unfence) == wanted, reply


def test_reply_parse(spark):
    good = one(spark, json.dumps({"title": "T é", "summary": "S", "more": [1]}), reply_parse)
    assert tuple(good) == ("T é", "S")
    fallback = (FALLBACK_TITLE, FALLBACK_SUMMARY)
    for reply in ('{"title": 1, "summary": "s"}', '{"title": "t"}', '{"title": null, "summary": "s"}', "[]", "", "{"):
        assert tuple(one(spark, reply, reply_parse)) == fallback, reply


def test_prompt_excerpt_always_ends_in_dots(spark):
    build = lambda c: prompt_excerpt(F.lit("u"), c)
    assert one(spark, "x" * 2000, build) == "URL: u\n\nContent:\n" + "x" * 1000 + "..."
    assert one(spark, "x", build) == "URL: u\n\nContent:\nx..."


def test_metadata_containment_is_strict(spark):
    rows = ['{"v":"1","n":1,"x":null}', '{"v":1}', "{}", '{"a":{"v":"1"}}']
    df = spark.createDataFrame([(r,) for r in rows], "m string")

    def hits(wanted):
        return [r["m"] for r in df.where(contains_metadata(F.col("m"), wanted)).collect()]

    assert hits({}) == rows
    assert hits({"v": "1"}) == rows[:1]
    assert hits({"v": 1}) == rows[1:2]
    assert hits({"x": None}) == rows[:1]
    assert hits({"v": "1", "n": 1}) == rows[:1]
    more = ['{"a": 1.5, "o": {"p": 2.0, "q": "x\'y"}, "l": [1, {"k": null}], "it\'s": true}', '{"a": "1.5", "o": {}, "l": []}']
    df = spark.createDataFrame([(r,) for r in more], "m string")
    for wanted, found in (
        ({"a": 1.5}, 1), ({"a": 1}, 0), ({"o": {"p": 2}}, 1), ({"o": {"q": "x\'y", "p": 2.0}}, 1), ({"o": {}}, 2),
        ({"o": {"z": None}}, 0), ({"l": [1]}, 1), ({"l": [{"k": None}, 1.0]}, 1), ({"l": []}, 2), ({"l": [2]}, 0),
        ({"it\'s": True}, 1), ({"it\'s": False}, 0),
    ):
        assert df.where(contains_metadata(F.col("m"), wanted)).count() == found, wanted


def test_numbers_are_compared_in_full(spark):
    def found(member: str, wanted) -> bool:
        df = spark.createDataFrame([('{"a":' + member + "}",)], "m string")
        return df.where(contains_metadata(F.col("m"), {"a": wanted})).count() == 1

    equal = [("1", 1.0), ("1.50", 1.5), ("100", 1e2), ("1e2", 100), ("1e-10", 1e-10), ("0.0000000001", 1e-10), ("-0", 0), ("-0.0", 0.0),
             ("0.1234567891", 0.1234567891), ("12345678901234567", 12345678901234567), ("10", 10), ("1200.0", 1200)]
    other = [("1e-10", 0), ("0.1234567894", 0.1234567891), ("0", 1e-10), ("1", 10), ("100", 1), ("12345678901234567", 12345678901234568), ("0.1", 0.10000000001)]
    assert [m for m, w in equal if not found(m, w)] == []
    assert [m for m, w in other if found(m, w)] == []


def test_entities(spark):
    text = "caf&eacute; &rarr;&nbsp;&copy; &amp;lt; &quot;x&quot; &#65;&#x42; &#233; &#128512; &#0; & &unknown; &#; a&#"
    assert one(spark, text, page.unescape) == 'café → © &lt; "x" AB é 😀 &#0; & &unknown; &#; a&#'
    assert one(spark, "plain", page.unescape) == "plain"
    every = [name for name in html.entities.html5 if name.endswith(";") and name != "nbsp;"]
    assert one(spark, " ".join(f"&{n}" for n in every), page.unescape) == " ".join(html.entities.html5[n] for n in every)
    assert one(spark, "&copy;&#233;&amp;", page.unescape) == html.unescape("&copy;&#233;&amp;")


SITE = """<html><head><title> A &amp; B </title><style>p{}</style></head><body>
<nav><ul><li><a href="/n">Nav link</a></li></ul></nav><!-- <a href="/hidden">x</a> -->
<script>var x = "<p>no</p>";</script><h2 class="t">Head</h2><p>One <b>two<br>three</p>
<ul><li>First</li><li>Second <a href='/s'>linked</a></li></ul>
<p>This paragraph holds more than ten words and so it is kept whole here.</p>
<p><a href=/l>These eleven words are all of them inside of one single link</a></p>
<pre>code &lt;x&gt;</pre><footer>Foot</footer></body></html>"""


def test_page_text(spark):
    text = one(spark, SITE, page.page_text)
    assert text.startswith("* Nav link\n\n## Head\n\nOne two\nthree\n\n* First\n* Second linked\n\nThis paragraph")
    assert "```\ncode <x>\n```" in text and text.endswith("Foot")
    assert "hidden" not in text and "var x" not in text


def test_code_keeps_its_white_space(spark):
    markup = "<p>A  b</p><pre>\n<code>def f(x):\n    if x &amp;&amp; y:\n\t<b>return</b></code>\n</pre>c <code>d</code><PRE class='q'>  e</PRE><pre> </pre>"
    assert one(spark, markup, page.page_text) == (
        "A b\n\n```\ndef f(x):\n    if x && y:\n\treturn\n```\n\nc `d`\n\n```\n  e\n```"
    )


def test_pruned_text_and_title(spark):
    assert one(spark, SITE, page.page_text_pruned) == (
        "This paragraph holds more than ten words and so it is kept whole here."
    )
    assert one(spark, SITE, page.page_title) == "A & B"
    assert one(spark, "<p>none</p>", page.page_title) is None


def test_anchors(spark):
    got = [tuple(a) for a in one(spark, SITE, page.anchors)]
    assert got[:2] == [("/n", "Nav link"), ("/s", "linked")]
    assert got[2][0] == "/l" and len(got) == 3


def test_documentation_urls(spark):
    records = {
        "a": {"info": {"project_urls": {"Documentation": "https://docs.example.com"}}},
        "b": {"info": {"project_urls": {"Documentation": ""}, "documentation_url": "https://old"}},
        "c": {"info": {"project_urls": None, "documentation_url": ""}},
        "d": {"info": {}},
    }
    rows = [(k, None, json.dumps(v)) for k, v in records.items()]
    resolved = resolve_documentation(spark.createDataFrame(rows, "package string, version string, record string"))
    good, bad = split_resolved(resolved)
    assert {r["package"]: r["documentation_url"] for r in good.collect()} == {
        "a": "https://docs.example.com", "b": "https://old",
    }
    assert {r["error"] for r in bad.collect()} == {
        "No documentation URL found for c", "No documentation URL found for d",
    }


def test_crawl_settings(spark):
    schema = "version string, depth int, strategy string, ignore_robots boolean, `limit` int, caching_enabled boolean"
    df = spark.createDataFrame([("1.0", 0, "dfs", True, 5, False), (None,) * 6], schema)
    assert [json.loads(r["s"]) for r in df.select(crawl_settings().alias("s")).collect()] == [
        {"version": "1.0", "depth": None, "strategy": "dfs", "ignore_robots": "true", "limit": "5", "caching_enabled": "false"},
        {"version": None, "depth": None, "strategy": "bfs", "ignore_robots": "false", "limit": None, "caching_enabled": "true"},
    ]
