"""Every registered query: name → function of a session and a table folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import html, urls
from docloom.functions.json import reply_parse
from docloom.functions.text import prompt_excerpt, unfence, words
from docloom.functions.vectors import cosine_similarity
from docloom.operators import catalog, ivf
from docloom.operators.answers import accepted_answers
from docloom.operators.chunking import chunk_documents
from docloom.operators.enrichment import (
    capture_key,
    chunk_metadata,
    extract_summary,
    extract_title,
    hashed_vector,
    hooked_titles,
    hooked_vectors,
    memo_misses,
    memoised,
    title_key,
    titles_failed,
    vector_key,
)
from docloom.operators.links import classify_links, page_links, queue_links
from docloom.operators.robots import allowed, parse_robots
from docloom.operators.search import (
    KnowledgeBase,
    context_pack,
    joined_chunks,
    match_chunks,
    match_chunks_batch,
    search_result,
    search_text,
)
from docloom.operators.sql_search import register_search
from docloom.operators.traversal import crawl, in_scope, links_per_page
from docloom.operators.upsert import constraint_report, reject_reasons, upsert
from docloom.plans import derived as d
from docloom.plans.packages import ingest_package_pages, ingest_packages
from docloom.schema import TABLES
from docloom.session import cut_lineage, shared_dir, tune
from docloom.sources.captures import read_capture_lines, resolve_redirects, scan_captures
from docloom.sources.files import document_files
from docloom.sources.kb_store import KnowledgeStore
from docloom.sources.registry import resolve_documentation
from docloom.streaming.ingest import page_stream, start_ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
TEXT_WIDTH = 256
LISTS = 8
PROBES = 2
MATCHES = 10
SMALL = 1000


def registered(name: str) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(tune(spark), sf_dir)

        REGISTERED[name] = run
        return query

    return register


def _r6(value: Column) -> Column:
    """Six decimals; NaN, which compares unlike itself elsewhere, as 2."""
    return F.when(F.isnan(value), F.lit(2.0)).otherwise(F.round(value, 6) + 0.0)


# --- chunks -------------------------------------------------------------------------------


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, with blank lines, and with fences."""
    documents = d.texts(spark, sf_dir, "documents").select("doc_id", "text")
    forms = F.map_from_arrays(
        F.array(F.lit("plain"), F.lit("paragraphs"), F.lit("fences")),
        F.array(
            F.col("text"),
            F.replace("text", F.lit("\n"), F.lit("\n\n")),
            F.replace("text", F.lit("\n"), F.lit("\n```\n")),
        ),
    )
    return documents.select("doc_id", F.explode(forms).alias("variant", "text"))


def _chunks_of_size(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return chunk_documents(_variants(spark, sf_dir), "text", size)


@registered("chunk_text_default")
def chunk_text_default(spark, sf_dir):
    return _chunks_of_size(spark, sf_dir, 5000)


@registered("chunk_text_small")
def chunk_text_small(spark, sf_dir):
    return _chunks_of_size(spark, sf_dir, SMALL)


@registered("document_scan")
def document_scan(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select(
        d.document_url().alias("url"), F.col("text").alias("content")
    )


def _document_chunks(spark, sf_dir) -> DataFrame:
    documents = d.texts(spark, sf_dir, "documents").select("doc_id", d.document_url().alias("url"), "text")
    return chunk_documents(documents, "text")


@registered("chunk_documents")
def chunk_documents_query(spark, sf_dir):
    return _document_chunks(spark, sf_dir).drop("doc_id")


@registered("chunks_per_page")
def chunks_per_page(spark, sf_dir):
    return catalog.chunks_per_page(_document_chunks(spark, sf_dir))


@registered("chunk_title_summary")
def chunk_title_summary(spark, sf_dir):
    content = F.col("content")
    return _document_chunks(spark, sf_dir).select(
        "doc_id", "chunk_number",
        extract_title(content).alias("title"), extract_summary(content).alias("summary"),
    )


@registered("chunk_metadata")
def chunk_metadata_query(spark, sf_dir):
    return _document_chunks(spark, sf_dir).select(
        "doc_id", "chunk_number",
        chunk_metadata(F.col("url"), F.col("content"), d.moment()).alias("metadata"),
    )


@registered("chunk_embedding")
def chunk_embedding(spark, sf_dir):
    """Non-zero places of each chunk's vector."""
    vectors = _document_chunks(spark, sf_dir).select(
        "doc_id", "chunk_number", hashed_vector(F.col("content"), TEXT_WIDTH).alias("vector")
    )
    return (
        vectors.select("doc_id", "chunk_number", F.posexplode_outer("vector").alias("place", "weight"))
        .where("weight <> 0")
        .select("doc_id", "chunk_number", "place", _r6(F.col("weight").cast("double")).alias("weight"))
    )


@registered("prompt_excerpt")
def prompt_excerpt_query(spark, sf_dir):
    return _document_chunks(spark, sf_dir).select(
        "doc_id", "chunk_number", prompt_excerpt(F.col("url"), F.col("content")).alias("request")
    )


@registered("content_keys")
def content_keys(spark, sf_dir):
    url, content = F.col("url"), F.col("content")
    return _document_chunks(spark, sf_dir).select(
        "doc_id", "chunk_number",
        capture_key(url).alias("capture_key"),
        title_key(url, content).alias("title_key"),
        vector_key(content).alias("vector_key"),
        vector_key(content, "native").alias("model_vector_key"),
    )


# --- memo ---------------------------------------------------------------------------------


def _keyed_texts(spark, sf_dir) -> DataFrame:
    """Whole texts keyed by content: exact copies share a key."""
    return d.texts(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.lit("").alias("url"), F.col("text").alias("content"),
        vector_key(F.col("text"), "native").alias("memo_key"),
    )


def _english_memo(spark, sf_dir) -> DataFrame:
    """What an earlier run over the English texts left behind."""
    held = _keyed_texts(spark, sf_dir).where("lang = 'en'").groupBy("memo_key").agg(
        F.any_value("content").alias("content")
    )
    return held.select(
        "memo_key",
        F.concat(F.lit("Stored: "), extract_title(F.col("content"))).alias("title"),
        extract_summary(F.col("content")).alias("summary"),
    )


@registered("memo_misses")
def memo_misses_query(spark, sf_dir):
    misses = memo_misses(_keyed_texts(spark, sf_dir), _english_memo(spark, sf_dir), ["content"])
    return misses.select("memo_key", F.length("content").alias("n_chars"))


@registered("memo_enrich")
def memo_enrich(spark, sf_dir):
    """Titles of all texts; Spanish ones fail, so they get the fallback and are not stored."""

    def compute(misses: DataFrame) -> DataFrame:
        content = F.col("content")
        values = F.struct(extract_title(content).alias("title"), extract_summary(content).alias("summary"))
        reply = F.when(~F.contains(content, F.lit("ción")), F.to_json(values))
        return misses.select(
            "memo_key", reply_parse(reply).alias("reply"), F.size(words(content)).alias("tokens")
        ).select("memo_key", "reply.*", F.lit(0.0).alias("cost"), "tokens")

    result = memoised(
        _keyed_texts(spark, sf_dir), _english_memo(spark, sf_dir),
        ["url", "content"], compute, "completion", titles_failed(),
    )
    stored = result.additions.select("memo_key", F.lit(True).alias("added"))
    return result.rows.join(stored, "memo_key", "left").select(
        "doc_id", "memo_hit", "title", "summary", F.coalesce("added", F.lit(False)).alias("added")
    )


def _hooked_keys(spark, sf_dir) -> DataFrame:
    return d.texts(spark, sf_dir, "documents").select(
        "doc_id", F.lit("").alias("url"), F.col("text").alias("content"), vector_key(F.col("text"), "hook").alias("memo_key")
    )


@registered("hook_titles")
def hook_titles(spark, sf_dir):
    """A model that leaves out texts with "ción", gives half a reply to those with "é" and no other one."""

    def model(batches):
        for batch in batches:
            kept = batch[~batch["content"].str.contains("ción")]
            half = kept["content"].str.contains("é")
            yield pd.DataFrame(
                {
                    "memo_key": kept["memo_key"], "title": kept["content"].str.len().astype(str),
                    "summary": pd.Series("done", kept.index).where(~half, None), "cost": 0.5, "tokens": 1,
                }
            )

    memo = spark.createDataFrame([], "memo_key string, title string, summary string")
    result = memoised(
        _hooked_keys(spark, sf_dir), memo, ["url", "content"], hooked_titles(model), "completion", titles_failed()
    )
    stored = result.additions.select("memo_key", F.lit(True).alias("added"))
    return result.rows.join(stored, "memo_key", "left").select(
        "doc_id", "title", "summary", F.coalesce("added", F.lit(False)).alias("added")
    )


@registered("hook_vectors")
def hook_vectors(spark, sf_dir):
    """A model that raises for a batch with "ción", and gives a misshapen vector to texts with "é"."""

    def model(batches):
        for batch in batches:
            if batch["content"].str.contains("ción").any():
                raise RuntimeError("no answer")
            sizes = batch["content"].str.len()
            short = batch["content"].str.contains("é")
            yield pd.DataFrame(
                {
                    "memo_key": batch["memo_key"],
                    "embedding": [[float(n)] if bad else [float(n), 1.0] for n, bad in zip(sizes, short, strict=True)],
                    "cost": 0.5, "tokens": 1,
                }
            )

    memo = spark.createDataFrame([], "memo_key string, embedding array<float>")
    # One text a call: what the model fails at is then the same in every run.
    result = memoised(
        _hooked_keys(spark, sf_dir), memo, ["content"], hooked_vectors(model, 2, rows=1), "embedding", F.col("failed")
    )
    stored = result.additions.select("memo_key", F.lit(True).alias("added"))
    return result.rows.join(stored, "memo_key", "left").select(
        "doc_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"),
        F.coalesce("added", F.lit(False)).alias("added"),
    )


# --- replies and registry -----------------------------------------------------------------


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


@registered("reply_parse")
def reply_parse_query(spark, sf_dir):
    """Good replies, wrong types, missing members and broken JSON, by language."""
    summary = _escaped(extract_summary(F.col("text")))
    reply = (
        F.when(F.col("lang") == "en", F.concat(
            F.lit('{"title":"'), "source", F.lit('","summary":"'), summary, F.lit('","extra":1}')))
        .when(F.col("lang") == "fr", F.concat(F.lit('{"title":"'), "source", F.lit('"}')))
        .when(F.col("lang") == "de", F.concat(
            F.lit('{"title":'), F.col("doc_id").cast("string"), F.lit(',"summary":"'), summary, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"title":"'), "source", F.lit('","summary":"'), summary))
    )
    return d.texts(spark, sf_dir, "documents").select("doc_id", reply_parse(reply).alias("r")).select(
        "doc_id", "r.*"
    )


@registered("reply_unfence")
def reply_unfence(spark, sf_dir):
    text = F.col("text")
    reply = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```\nDone.")))
        .when(F.col("lang") == "fr", F.concat(F.lit("```json\n"), text))
        .when(F.col("lang") == "de", F.concat(F.lit("```"), F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("```")))
        .otherwise(F.concat(F.lit(" \n"), text, F.lit("\n ")))
    )
    return d.texts(spark, sf_dir, "documents").select("doc_id", unfence(reply).alias("payload"))


def _packages(spark, sf_dir) -> DataFrame:
    """A registry record per document; where its documentation is said differs by language."""
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string"))
    record = (
        F.when(F.col("lang") == "en", F.concat(
            F.lit('{"info":{"project_urls":{"Documentation":"'), url, F.lit('"},"documentation_url":"x"}}')))
        .when(F.col("lang") == "fr", F.concat(
            F.lit('{"info":{"project_urls":{"Documentation":""},"documentation_url":"'), url, F.lit('"}}')))
        .when(F.col("lang") == "de", F.concat(
            F.lit('{"info":{"project_urls":null,"documentation_url":"'), url, F.lit('"}}')))
        .otherwise(F.lit('{"info":{"project_urls":{},"documentation_url":null}}'))
    )
    version = F.when(F.col("lang") == "en", F.concat(F.lit("1."), F.col("doc_id").cast("string")))
    return d.table(spark, sf_dir, "documents").select(
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("package"),
        version.alias("version"),
        record.alias("record"),
    )


@registered("docs_url_resolve")
def docs_url_resolve(spark, sf_dir):
    return resolve_documentation(_packages(spark, sf_dir)).drop("record_url")


@registered("registry_url")
def registry_url(spark, sf_dir):
    return _packages(spark, sf_dir).select(
        "package", urls.registry_url(F.col("package"), F.col("version")).alias("record_url")
    )


# --- URLs and pages -----------------------------------------------------------------------


@registered("url_parts")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return d.table(spark, sf_dir, "pages").select(
        "page_id",
        urls.url_scheme(url).alias("scheme"), urls.url_netloc(url).alias("netloc"),
        urls.url_path(url).alias("path"), urls.url_query(url).alias("query"),
        urls.url_fragment(url).alias("fragment"),
    )


@registered("url_to_filename")
def url_to_filename(spark, sf_dir):
    return d.table(spark, sf_dir, "pages").select("page_id", urls.url_to_filename(F.col("url")).alias("filename"))


@registered("url_to_filename_wide")
def url_to_filename_wide(spark, sf_dir):
    """Letters and numbers of every script stay; joiners and other signs do not."""
    url = F.concat("url", F.lit("café_x²½‿東-"))
    return d.table(spark, sf_dir, "pages").select("page_id", urls.url_to_filename(url).alias("filename"))


@registered("url_join")
def url_join(spark, sf_dir):
    return d.table(spark, sf_dir, "pages").select("page_id", urls.robots_url(F.col("url")).alias("robots_url"))


@registered("link_resolve")
def link_resolve(spark, sf_dir):
    """Each anchor in five written forms."""
    bare = F.regexp_replace("href", "^/", "")
    forms = F.array(
        F.col("href"), bare, F.concat(F.lit("?q="), bare), F.concat(F.lit("//cdn.example.org/"), bare),
        F.concat(F.lit("mailto:"), bare),
    )
    links = page_links(d.texts(spark, sf_dir, "pages"))
    return links.select(
        "page_id", "link_pos", "url", F.posexplode(forms).alias("form", "written")
    ).select(
        "page_id", "link_pos", "form",
        urls.link_resolve(F.col("url"), F.col("written")).alias("target"),
    )


@registered("page_links")
def page_links_query(spark, sf_dir):
    return page_links(d.texts(spark, sf_dir, "pages")).drop("url")


@registered("link_class")
def link_class(spark, sf_dir):
    """Anchors as written, and again on a foreign host."""
    links = page_links(d.texts(spark, sf_dir, "pages"))
    foreign = links.withColumn("href", F.concat(F.lit("https://cdn.example.org"), "href"))
    return classify_links(links.unionByName(foreign)).select(
        "page_id", "link_pos", "target", "link_class"
    )


@registered("page_text")
def page_text(spark, sf_dir):
    return d.texts(spark, sf_dir, "pages").select("page_id", html.page_text(F.col("html")).alias("content"))


@registered("page_text_code")
def page_text_code(spark, sf_dir):
    """Pages with a sample of code behind each first heading."""
    code = '</h1><pre class="x"><code>def f(x):\n    if x &lt; 1:\n\treturn 0\n</code></pre>'
    coded = F.replace("html", F.lit("</h1>"), F.lit(code))
    return d.texts(spark, sf_dir, "pages").select("page_id", html.page_text(coded).alias("content"))


@registered("page_text_pruned")
def page_text_pruned(spark, sf_dir):
    return d.texts(spark, sf_dir, "pages").select(
        "page_id", html.page_text_pruned(F.col("html")).alias("content")
    )


# Quotes that hold a ">", a "<" that opens nothing, references without semicolon, comments that hold tags.
ODD_MARKUP = (
    '<p title="a > b">1 < 2 and 3 > 2</p><p><a title="a > b" href="/x?a=1&copy=2">t &copy B</a><img alt=\'x>y\'></p>'
    "<!-- > <a href='/no'>no</a> --><p>x&ampy &unknown; &#128;<a name=q></a><a class='>' href=/y></a></p>"
    '<script>if (a < b) document.write("<p>no</p>")</script><svg><title>no</title><svg></svg>no</svg>'
    '<pre title=">">if a &lt; b:\n    return "&lt;p>"\n</pre><ul><li><a href = "z" >in < b</a></li><li>last</li></ul>'
)


def _with_odd_markup(html_: Column) -> Column:
    return F.replace(html_, F.lit("</h1>"), F.lit("</h1>" + ODD_MARKUP))


@registered("page_text_odd")
def page_text_odd(spark, sf_dir):
    """Pages with markup that patterns misread behind their first heading."""
    odd = _with_odd_markup(F.col("html"))
    return d.texts(spark, sf_dir, "pages").select("page_id", html.page_text(odd).alias("content"))


@registered("page_links_odd")
def page_links_odd(spark, sf_dir):
    pages = d.texts(spark, sf_dir, "pages").select("page_id", _with_odd_markup(F.col("html")).alias("html"))
    return page_links(pages)


@registered("page_text_pruned_nested")
def page_text_pruned_nested(spark, sf_dir):
    """Pages with side parts inside of side parts."""
    long = "eleven words that would stay if this were no side part"
    inner = f"<nav title='</nav>'><aside><p>{long}</p></aside><nav><p>{long}</p></nav><p>{long}</p></nav>"
    nested = F.replace("html", F.lit("</h1>"), F.lit(f"</h1><header>{inner}<header><p>{long}</p></header><p>{long}</p></header>"))
    return d.texts(spark, sf_dir, "pages").select("page_id", html.page_text_pruned(nested).alias("content"))


@registered("page_meta")
def page_meta(spark, sf_dir):
    """Pages with names, repeated names and a canonical address planted in their heads, by their number."""
    number = F.col("page_id").cast("string")
    planted = (
        F.when(F.col("page_id") % 3 == 0, F.concat(
            F.lit('<meta name="Description" content="first > '), number, F.lit('"><META content=second NAME=description>'),
            F.lit("<meta property='og:title' content=''><meta name=empty><svg><title>no</title></svg>")))
        .when(F.col("page_id") % 3 == 1, F.concat(
            F.lit("<link rel='alternate' href='/no'><link href=\"https://example.org/p/"), number,
            F.lit('?a=1&amp;b=2" rel="me Canonical"><link rel=canonical href=/later>')))
        .otherwise(F.lit("<!-- <meta name=no content=no> --><meta property=og:type content=article />"))
    )
    pages = d.texts(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("<title>"), F.concat(planted, F.lit("<title>"))))
    found = pages.select("page_id", html.page_meta(F.col("html")).alias("m"))
    return found.select(
        "page_id", "m.title", "m.language", "m.canonical", F.col("m.meta")["description"].alias("description"),
        F.col("m.meta")["og:type"].alias("og_type"), F.size("m.meta").alias("names"),
    )


@registered("page_title")
def page_title(spark, sf_dir):
    return d.texts(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@registered("page_capture_scan")
def page_capture_scan(spark, sf_dir):
    held = d.captures(spark, sf_dir)
    scanned = scan_captures(held.select("url", "html"), d.redirects(held))
    hrefs = F.array_join(F.transform("links", lambda x: x["href"]), " ")
    return scanned.select("url", "final_url", "content", hrefs.alias("links"))


@registered("capture_lines")
def capture_lines(spark, sf_dir):
    """Captures as JSON lines, some cut off, mistyped or without an address, written and read again."""
    number, url = F.col("page_id") % 7, F.col("url")
    text = F.struct(F.col("html").alias("raw_markdown"))
    links = F.struct(F.array(F.struct(F.lit("/a").alias("href"), url.alias("text")), F.struct(F.lit("/b").alias("href"), F.lit("b").alias("text"))).alias("internal"))
    record = F.to_json(F.struct(
        F.when(number != 1, url).alias("url"), F.when(number == 2, F.concat(url, F.lit("/end"))).alias("final_url"),
        F.when(number != 3, text).alias("markdown_v2"), F.when(number != 4, links).alias("links"), F.lit(200).alias("status_code"),
    ))
    line = (
        F.when(number == 0, F.expr("substring(record, 1, length(record) - 3)"))
        .when(number == 5, F.lit('{"url": ["no", "text"], "links": 3}'))
        .otherwise(F.col("record"))
    )
    folder = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    d.texts(spark, sf_dir, "pages").withColumn("record", record).select(line.alias("value")).write.text(folder)
    good, rejects = read_capture_lines(spark.read.text(folder))
    held = good.select(
        "url", "final_url", F.length("content").alias("n_chars"), F.size("links").alias("n_links"),
        F.get("links", F.lit(0))["text"].alias("first_link"), F.lit(None).cast("string").alias("reason"),
    )
    return held.unionByName(rejects.select("reason"), allowMissingColumns=True)


@registered("doc_file_sink")
def doc_file_sink(spark, sf_dir):
    pages = d.texts(spark, sf_dir, "pages").select(
        "page_id", "url", html.page_text(F.col("html")).alias("content")
    )
    return document_files(pages, "page_id")


@registered("redirect_resolve")
def redirect_resolve(spark, sf_dir):
    held = d.captures(spark, sf_dir).select("page_id", "url")
    return resolve_redirects(held, d.redirects(held)).select("page_id", "url", "final_url")


# --- traversal ----------------------------------------------------------------------------


def _site(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages = cut_lineage(d.site_pages(spark, sf_dir))
    return pages, d.site_links(pages)


@registered("link_normalize")
def link_normalize(spark, sf_dir):
    pages, links = _site(spark, sf_dir)
    target = urls.normalize_link(F.col("href"), F.col("url"), F.col("final_url"))
    return links.join(pages.select("url", "final_url"), "url").select(
        "url", "link_pos", target.alias("target")
    )


@registered("link_dedup")
def link_dedup(spark, sf_dir):
    pages, links = _site(spark, sf_dir)
    return queue_links(links.join(pages.select("url", "final_url"), "url"))


@registered("crawl_scope_filter")
def crawl_scope_filter(spark, sf_dir):
    pages, links = _site(spark, sf_dir)
    requests = links.select(F.col("url").alias("start_url"), "link_pos", F.col("href").alias("url"))
    return in_scope(resolve_redirects(requests, d.redirects(pages))).select(
        "start_url", "link_pos", "url", "final_url"
    )


@registered("robots_filter")
def robots_filter(spark, sf_dir):
    pages = d.site_pages(spark, sf_dir)
    return allowed(pages.select("page_id", "url"), d.site_rules(pages)).select("page_id", "url", "allowed")


def _crawled(spark, sf_dir, one: bool = False, what=crawl, **bounds) -> DataFrame:
    pages, links = _site(spark, sf_dir)
    starts = d.site_starts(pages)
    if one:
        largest = (
            pages.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(1)
        )
        starts = starts.join(largest, "host", "left_semi")
    return what(starts.drop("host"), pages, links, d.site_rules(pages), **bounds)


@registered("crawl_bfs")
def crawl_bfs(spark, sf_dir):
    return _crawled(spark, sf_dir, one=True)


@registered("crawl_bfs_multi")
def crawl_bfs_multi(spark, sf_dir):
    return _crawled(spark, sf_dir)


@registered("crawl_bfs_depth")
def crawl_bfs_depth(spark, sf_dir):
    return _crawled(spark, sf_dir, depth=1)


@registered("crawl_bfs_limited")
def crawl_bfs_limited(spark, sf_dir):
    return _crawled(spark, sf_dir, limit=3)


@registered("crawl_totals")
def crawl_totals(spark, sf_dir):
    return catalog.pages_per_depth(_crawled(spark, sf_dir))


@registered("robots_parse")
def robots_parse(spark, sf_dir):
    """A robots file per host: comments, groups that an empty line ends, several agents."""
    host = F.col("netloc")
    body = (
        F.when(F.startswith(host, F.lit("www.")), "User-agent: *\nDisallow: /a # x\n#\nAllow: /b\n\nDisallow: /c\n")
        .when(F.startswith(host, F.lit("blog.")), "User-agent: x\nDisallow: /\n\nuser-agent: *\nUser-agent: y\nDisallow: /p")
        .when(F.startswith(host, F.lit("m.")), "User-agent: *\n\nDisallow: /q\n")
        .otherwise("User-agent: *\r\nDisallow:\r\n")
    )
    hosts = d.table(spark, sf_dir, "pages").select(urls.url_netloc(F.col("url")).alias("netloc")).distinct()
    return parse_robots(hosts.select("netloc", body.alias("body")))


@registered("package_ingest")
def package_ingest(spark, sf_dir):
    """A package per host, with bounds by kind of host, from its record to tools, pages and chunks."""
    pages, links = _site(spark, sf_dir)
    hrefs = F.sort_array(F.collect_list(F.struct("link_pos", "href")))
    link = F.transform(hrefs, lambda x: F.struct(x["href"].alias("href"), F.lit("").alias("text")))
    captures = pages.join(links.groupBy("url").agg(link.alias("links")), "url").select(
        "url", "final_url", "content", "links"
    )
    host = F.col("host")
    record = F.concat(F.lit('{"info":{"documentation_url":"'), F.col("start_url"), F.lit('"}}'))
    packages = d.site_starts(pages).select(
        host.alias("package"), F.lit(None).cast("string").alias("version"), record.alias("record"),
        F.when(F.startswith(host, F.lit("www.")), 1).alias("depth"), F.lit("bfs").alias("strategy"),
        F.startswith(host, F.lit("m.")).alias("ignore_robots"),
        F.when(F.startswith(host, F.lit("blog.")), 3).alias("limit"), F.lit(True).alias("caching_enabled"),
    )
    store = KnowledgeStore(spark, f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}")
    ingest_packages(store, packages, captures, d.site_rules(pages), d.moment(), width=d.WIDTH)
    kb = store.knowledge_base()
    tools = kb.tool_docs.select("tool_name", F.col("url").alias("tool_url"), F.col("metadata").alias("settings"))
    found = joined_chunks(kb).select("tool_name", "url", "chunk_number", "content")
    return tools.join(found, "tool_name", "left")


@registered("crawl_own_bounds")
def crawl_own_bounds(spark, sf_dir):
    """Crawls from all hosts at once, each with bounds of its own: depth 0, no page at all, without robots, or none."""
    pages, links = _site(spark, sf_dir)
    host = F.col("host")
    starts = d.site_starts(pages).select(
        "crawl_id", "start_url", F.when(F.startswith(host, F.lit("www.")), 0).alias("depth"),
        F.when(F.startswith(host, F.lit("blog.")), 0).alias("limit"), F.startswith(host, F.lit("m.")).alias("ignore_robots"),
    )
    return crawl(starts, pages, links, d.site_rules(pages))


@registered("package_recrawl")
def package_recrawl(spark, sf_dir):
    """Packages stored twice, the second time from changed pages: where captures are remembered, nothing changes."""
    pages, links = _site(spark, sf_dir)
    anchor = F.concat(F.lit('<a href="'), F.col("href"), F.lit('"></a>'))
    marked = links.where("href <> ''").groupBy("url").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("link_pos", anchor.alias("a")))), lambda x: x["a"]), "").alias("links")
    )
    place = F.concat(F.lit("page "), F.col("place").cast("string"), F.lit(" of its host"))
    body = F.concat(F.lit("<p>"), F.when(F.col("content") == "", "").otherwise(place), F.lit("</p>"), "links")
    first = pages.join(marked, "url").select("url", body.alias("html"))
    later = first.withColumn("html", F.replace("html", F.lit("page "), F.lit("new page ")))
    host = F.col("host")
    packages = d.site_starts(pages).select(
        host.alias("package"), F.lit(None).cast("string").alias("version"),
        F.concat(F.lit('{"info":{"documentation_url":"'), F.col("start_url"), F.lit('"}}')).alias("record"),
        F.lit(1).alias("depth"), F.lit("bfs").alias("strategy"), F.lit(False).alias("ignore_robots"),
        F.lit(None).cast("int").alias("limit"), F.when(F.startswith(host, F.lit("www.")), False).alias("caching_enabled"),
    )
    redirects = d.redirects(pages.select("url"))
    store = KnowledgeStore(spark, f"{shared_dir(spark)}/recrawl-{uuid.uuid4().hex}")
    for held, as_of in ((first, d.AS_OF), (later, d.LATER)):
        ingest_package_pages(store, packages, held, redirects, d.site_rules(pages), d.moment(as_of), width=d.WIDTH)
    remembered = store.memo("capture").select(F.col("final_url").alias("seen")).distinct()
    found = joined_chunks(store.knowledge_base()).select("tool_name", "url", "content")
    return found.join(remembered, found["url"] == remembered["seen"], "left").select(
        "tool_name", "url", "content", F.col("seen").isNotNull().alias("remembered")
    )


@registered("links_per_page")
def links_per_page_query(spark, sf_dir):
    return _crawled(spark, sf_dir, what=links_per_page)


# --- catalog and usage --------------------------------------------------------------------


def _catalog(spark, sf_dir) -> DataFrame:
    """Tools per host and scheme-less root; one more per top-level domain has no page."""
    pages = d.table(spark, sf_dir, "pages").select(
        urls.url_netloc(F.col("url")).alias("host"), F.split_part("url", F.lit("#"), F.lit(1)).alias("url")
    )
    names = pages.select("host").unionByName(
        pages.select(F.regexp_extract("host", r"[^.]+$", 0).alias("host"))
    )
    tools = names.distinct().select(
        F.xxhash64("host").alias("id"), F.col("host").alias("tool_name"),
        F.lit("official_package_documentation").alias("source_type"), d.tool_url("host").alias("url"),
    )
    held = pages.distinct().select(F.xxhash64("host").alias("tool_id"), "url")
    return catalog.tool_catalog(tools, held)


@registered("tool_catalog")
def tool_catalog(spark, sf_dir):
    return _catalog(spark, sf_dir)


@registered("tool_catalog_line")
def tool_catalog_line(spark, sf_dir):
    return catalog.catalog_line(_catalog(spark, sf_dir))


def _usage(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "completion").otherwise("embedding")
    return d.table(spark, sf_dir, "events").select(
        kind.alias("kind"), (F.col("value") / 1000).alias("cost"), F.col("user_id").alias("tokens")
    )


@registered("usage_totals")
def usage_totals(spark, sf_dir):
    totals = catalog.usage_totals(_usage(spark, sf_dir))
    return totals.select("kind", _r6(F.col("cost")).alias("cost"), "tokens")


@registered("usage_priced")
def usage_priced(spark, sf_dir):
    """Calls with a model each; one model has no price."""
    events = d.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("tokens"))
    kind = F.when(F.col("model").isin("click", "view"), "completion").otherwise("embedding")
    prices = spark.createDataFrame([("click", 0.25), ("view", 0.5)], "model string, cost_per_token double")
    totals = catalog.usage_totals(catalog.priced(events.withColumn("kind", kind), prices).select("kind", "cost", "tokens"))
    return totals.select("kind", _r6(F.col("cost")).alias("cost"), "tokens")


@registered("usage_summary")
def usage_summary(spark, sf_dir):
    return catalog.usage_summary(_usage(spark, sf_dir))


# --- knowledge base -----------------------------------------------------------------------


def _stored(spark, sf_dir, until: str, store: KnowledgeStore | None = None) -> DataFrame:
    """The table ``until`` after both batches, with all that it refers to; through ``store`` if there is one."""

    def _upsert(existing: dict, name: str, incoming: DataFrame, when: str) -> None:
        if store is None:
            existing[name] = upsert(name, existing[name], incoming, d.moment(when))
        else:
            store.upsert(name, incoming, d.moment(when))
            existing[name] = store.read(name)

    documents = d.texts(spark, sf_dir, "documents")
    kb = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    for batch, when, size in ((1, d.AS_OF, SMALL), (2, d.LATER, 5000)):
        rows = d.batch_rows(documents, batch)
        tools = rows.select(
            "tool_name", "source_type", F.col("tool_url").alias("url"), "seq",
            F.format_string('{"version":"%d"}', "seq").alias("metadata"),
        )
        _upsert(kb, "tool_docs", tools, when)
        if until == "tool_docs":
            continue
        ids = kb["tool_docs"].select(F.col("id").alias("tool_id"), "tool_name")
        pages = rows.select("tool_name", "url", "seq").join(ids, "tool_name")
        _upsert(kb, "page", pages.select("tool_id", "url", "seq"), when)
        if until == "page":
            continue
        held = kb["page"].select(F.col("id").alias("page_id"), "url")
        texts = chunk_documents(rows.select("url", "text", "seq"), "text", size).join(held, "url")
        content = F.col("content")
        chunks = texts.select(
            "page_id", "chunk_number", "seq", "content",
            F.concat(F.format_string("%d: ", "seq"), extract_title(content)).alias("title"),
            extract_summary(content).alias("summary"),
            F.lit(None).cast("array<float>").alias("embedding"),
            chunk_metadata(F.col("url"), content, d.moment(when)).alias("metadata"),
        )
        _upsert(kb, "page_chunk", chunks, when)
    return kb[until]


def _stamped(df: DataFrame) -> DataFrame:
    """Times as text, so that every engine prints them alike."""
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd")).withColumn(
        "updated_at", F.date_format("updated_at", "yyyy-MM-dd")
    )


@registered("upsert_tools")
def upsert_tools(spark, sf_dir):
    return _stamped(_stored(spark, sf_dir, "tool_docs"))


@registered("upsert_pages")
def upsert_pages(spark, sf_dir):
    return _stamped(_stored(spark, sf_dir, "page"))


@registered("upsert_chunks")
def upsert_chunks(spark, sf_dir):
    return _stamped(_stored(spark, sf_dir, "page_chunk").drop("embedding"))


@registered("store_upsert")
def store_upsert(spark, sf_dir):
    """Both batches as commits to a store, read back before and after its changes are merged."""
    store = KnowledgeStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    _stored(spark, sf_dir, "page_chunk", store)
    # A reader's folders stay until they are vacuumed.
    before = store.read("page_chunk")
    store.compact("page_chunk", least=1)
    both = before.unionByName(store.read("page_chunk")).drop("embedding").groupBy(
        *[c for c in before.columns if c != "embedding"]
    )
    return _stamped(both.agg(F.count("*").alias("reads")))


def _flawed(spark, sf_dir) -> tuple[KnowledgeBase, DataFrame]:
    """A base without Spanish pages, and chunks with a flaw per language and source."""
    documents = d.table(spark, sf_dir, "documents")
    kb = d.knowledge_base(spark, sf_dir)
    pages = d.kb_pages(documents.where("lang <> 'es'"))
    marks = documents.select((F.col("doc_id") + 1).alias("page_id"), "lang", "source")
    # Both the sound and the flawed chunks are made of these, which are cut once.
    chunks = cut_lineage(kb.page_chunk.join(marks, "page_id"))
    flawed = (
        chunks.withColumn("title", F.when(F.col("lang") != "fr", F.col("title")))
        .withColumn("embedding", F.when(F.col("lang") == "de", F.slice("embedding", 1, 3))
                    .otherwise(F.col("embedding")))
        .withColumn("metadata", F.when(F.col("source") == "src5", F.lit("{")).otherwise(F.col("metadata")))
        .drop("lang", "source")
    )
    return KnowledgeBase(kb.tool_docs, pages, chunks.drop("lang", "source")), flawed


@registered("upsert_rejects")
def upsert_rejects(spark, sf_dir):
    kb, flawed = _flawed(spark, sf_dir)
    return reject_reasons(flawed, kb.page, d.WIDTH).select("page_id", "chunk_number", "reason")


@registered("kb_constraint_report")
def kb_constraint_report(spark, sf_dir):
    """Every flaw once, and all sound chunks a second time."""
    kb, flawed = _flawed(spark, sf_dir)
    return constraint_report(kb.tool_docs, kb.page, flawed.unionByName(kb.page_chunk), d.WIDTH)


# --- search -------------------------------------------------------------------------------


@registered("cosine_similarity")
def cosine_similarity_query(spark, sf_dir):
    """Each chunk's vector against the next document's."""
    chunks = d.knowledge_base(spark, sf_dir).page_chunk.select("id", "page_id", "embedding")
    other = d.vector_queries(spark, sf_dir).select(F.col("query_id").alias("page_id"), "vector")
    similarity = cosine_similarity(F.col("embedding"), F.col("vector"))
    return chunks.join(other, "page_id", "left").select("id", _r6(similarity).alias("similarity"))


@registered("chunk_page_tool_join")
def chunk_page_tool_join(spark, sf_dir):
    return joined_chunks(d.knowledge_base(spark, sf_dir)).select(
        "id", "url", "tool_name", "source_type", "chunk_number", "title"
    )


def _first_vector(spark, sf_dir) -> list[float]:
    row = d.vector_queries(spark, sf_dir).orderBy("query_id").first()
    return row["vector"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", _r6(F.col("similarity")))


@registered("kb_search")
def kb_search(spark, sf_dir):
    kb = d.knowledge_base(spark, sf_dir)
    return _rounded(match_chunks(kb, _first_vector(spark, sf_dir), MATCHES))


@registered("kb_search_filtered")
def kb_search_filtered(spark, sf_dir):
    kb = d.knowledge_base(spark, sf_dir)
    found = match_chunks(kb, _first_vector(spark, sf_dir), MATCHES, {"version": "2", "strategy": "bfs"})
    return _rounded(found)


def _vector_literal(vector: list[float]) -> str:
    return f"CAST(array({', '.join(f'{x!r}D' for x in vector)}) AS ARRAY<FLOAT>)"


def _sql_search(spark, sf_dir, arguments: str) -> DataFrame:
    name = register_search(spark, d.knowledge_base(spark, sf_dir), "match_chunks")
    return _rounded(spark.sql(f"SELECT * FROM {name}({_vector_literal(_first_vector(spark, sf_dir))}{arguments})"))


@registered("kb_search_sql")
def kb_search_sql(spark, sf_dir):
    """The same search, called from SQL."""
    return _sql_search(spark, sf_dir, "")


@registered("kb_search_sql_filtered")
def kb_search_sql_filtered(spark, sf_dir):
    return _sql_search(spark, sf_dir, f", {MATCHES}, map('version', '2', 'strategy', 'bfs')")


@registered("kb_search_result")
def kb_search_result(spark, sf_dir):
    kb = d.knowledge_base(spark, sf_dir)
    return _rounded(search_result(match_chunks(kb, _first_vector(spark, sf_dir), MATCHES)))


@registered("kb_search_batch")
def kb_search_batch(spark, sf_dir):
    kb = d.knowledge_base(spark, sf_dir)
    found = match_chunks_batch(kb, d.vector_queries(spark, sf_dir), MATCHES)
    return _rounded(
        found.select("query_id", "rank", "id", "url", "tool_name", "chunk_number", "title", "similarity")
    )


@registered("kb_search_text")
def kb_search_text(spark, sf_dir):
    """Benchmark texts as questions over the hashed vectors of all chunks; none is in the memo yet."""
    documents = d.table(spark, sf_dir, "documents")
    content = F.col("content")
    chunks = cut_lineage(
        _document_chunks(spark, sf_dir).select(
            d.chunk_id().alias("id"), (F.col("doc_id") + 1).alias("page_id"), "chunk_number",
            extract_title(content).alias("title"), extract_summary(content).alias("summary"), "content",
            hashed_vector(content, TEXT_WIDTH).alias("embedding"), F.lit("{}").alias("metadata"),
        )
    )
    kb = KnowledgeBase(d.kb_tools(documents), d.kb_pages(documents), chunks)
    asked = d.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    memo = spark.createDataFrame([], "memo_key string, embedding array<float>")
    found, _ = search_text(kb, asked, memo, 5, width=TEXT_WIDTH)
    return _rounded(found)


@registered("context_pack")
def context_pack_query(spark, sf_dir):
    kb = d.knowledge_base(spark, sf_dir)
    packed = context_pack(match_chunks_batch(kb, d.vector_queries(spark, sf_dir), 3))
    return packed.select("query_id", "content", F.array_join("reference_urls", " ").alias("reference_urls"))


def _vectors(spark, sf_dir) -> DataFrame:
    return d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _fixed_index(spark, sf_dir) -> ivf.ListIndex:
    """Lists around the first vectors by id, written and read again as partitions."""
    vectors = _vectors(spark, sf_dir)
    rows = vectors.orderBy("id").limit(LISTS).collect()
    index = ivf.build(vectors, centres=np.array([row["embedding"] for row in rows], dtype=np.float64))
    path = f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
    ivf.write_index(index, path)
    return ivf.read_index(spark, path)


@registered("ivf_assign")
def ivf_assign(spark, sf_dir):
    return _fixed_index(spark, sf_dir).rows.select("id", F.col("list_id").cast("int").alias("list_id"))


@registered("ivf_search")
def ivf_search(spark, sf_dir):
    """Trained lists, all of them probed: equal to the exact search."""
    index = ivf.build(_vectors(spark, sf_dir), LISTS)
    return _rounded(ivf.search(index, d.vector_queries(spark, sf_dir), MATCHES, probes=LISTS))


@registered("ivf_search_probed")
def ivf_search_probed(spark, sf_dir):
    """Two lists for each query; others are not read for it."""
    index = _fixed_index(spark, sf_dir)
    return _rounded(ivf.search(index, d.vector_queries(spark, sf_dir), MATCHES, probes=PROBES))


@registered("ivf_recall")
def ivf_recall(spark, sf_dir):
    found = ivf.recall(_fixed_index(spark, sf_dir), d.vector_queries(spark, sf_dir), MATCHES, probes=PROBES)
    return found.select("query_id", "found", _r6(F.col("recall")).alias("recall"))


@registered("accepted_answer")
def accepted_answer(spark, sf_dir):
    questions, answers = d.questions_and_answers(d.texts(spark, sf_dir, "conversations"))
    asked = d.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return accepted_answers(questions, answers, asked)


# --- streaming ----------------------------------------------------------------------------


@registered("stream_ingest")
def stream_ingest(spark, sf_dir):
    """The pages as a stream into a new store; equal to cutting them in one batch."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = KnowledgeStore(spark, root)
    stream = page_stream(spark, sf_dir, "pages.parquet")
    start_ingest(stream, store, f"{root}/progress", d.moment(), width=d.WIDTH).awaitTermination()
    return joined_chunks(store.knowledge_base()).select(
        "tool_name", "url", "chunk_number", "title", "summary", "content"
    )
