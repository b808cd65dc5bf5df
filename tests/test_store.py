from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.operators import catalog
from docloom.operators.enrichment import (
    enrich,
    hashed_vector,
    hooked_titles,
    hooked_vectors,
    memoised,
    native_titles,
    titles_failed,
)
from docloom.operators.search import joined_chunks, match_chunks
from docloom.operators.upsert import changed_rows, constraint_report, prune_stale, split_rejects, upsert
from docloom.plans.derived import moment
from docloom.plans.ingest import ingest_documents
from docloom.schema import PAGE, TABLES
from docloom.sources.files import document_files, write_documents
from docloom.sources.kb_store import KnowledgeStore
from docloom.streaming.ingest import page_stream, start_ingest



def T1():  # noqa: N802
    return moment("2025-01-01 00:00:00")


def T2():  # noqa: N802
    return moment("2025-02-01 00:00:00")


DOCUMENT = (
    "tool_name string, source_type string, tool_url string, tool_metadata string, url string,"
    " content string, seq long"
)


def documents(spark, rows):
    full = [(t, "official_package_documentation", f"https://{t}/", "{}", u, c, s) for t, u, c, s in rows]
    return spark.createDataFrame(full, DOCUMENT)


def test_upsert_keeps_ids_and_takes_the_last(spark):
    empty = spark.createDataFrame([], PAGE)
    schema = "tool_id long, url string, seq int"
    first = upsert("page", empty, spark.createDataFrame([(1, "b", 1), (1, "a", 1), (1, "a", 2)], schema), T1())
    assert {(r["id"], r["url"]) for r in first.collect()} == {(1, "a"), (2, "b")}
    again = spark.createDataFrame([(1, "b", 1), (2, "a", 1)], schema)
    second = upsert("page", first, again, T2())
    rows = {r["id"]: r for r in second.collect()}
    assert {i: (r["tool_id"], r["url"]) for i, r in rows.items()} == {1: (1, "a"), 2: (1, "b"), 3: (2, "a")}
    assert {i: (r["created_at"].month, r["updated_at"].month) for i, r in rows.items()} == {1: (1, 1), 2: (1, 2), 3: (2, 2)}
    third = upsert("page", second, again, T2())
    assert sorted(third.collect()) == sorted(second.collect())


def test_replaced_values_may_become_null(spark):
    schema = (
        "page_id long, chunk_number int, title string, summary string, content string,"
        " embedding array<float>, metadata string, seq int"
    )
    first = upsert(
        "page_chunk", spark.createDataFrame([], TABLES["page_chunk"]),
        spark.createDataFrame([(1, 0, "t", "s", "c", [1.0], "{}", 1)], schema), T1(),
    )
    later = spark.createDataFrame([(1, 0, "t2", "s", "c", None, "{}", 1)], schema)
    row = changed_rows("page_chunk", first, later, T2()).first()
    assert (row["id"], row["title"], row["embedding"]) == (1, "t2", None)


def test_rejects_do_not_hold_up_the_others(spark):
    schema = "page_id long, chunk_number int, title string, summary string, content string, embedding array<float>, metadata string"
    rows = [
        (1, 0, "t", "s", "c", [1.0, 2.0], "{}"), (1, 1, None, "s", "c", [1.0, 2.0], "{}"),
        (1, 2, "t", "s", "c", [1.0], "{}"), (9, 0, "t", "s", "c", [1.0, 2.0], "{}"),
        (1, 3, "t", "s", "c", [1.0, 2.0], "{no"), (1, 4, "t", "s", "c", None, "{}"),
    ]
    sound, rejected = split_rejects(
        spark.createDataFrame(rows, schema), spark.createDataFrame([(1,)], "id long"), width=2
    )
    assert {r["chunk_number"] for r in sound.collect()} == {0, 4}
    assert {r["reason"] for r in rejected.collect()} == {"null title", "vector size", "missing page", "bad metadata"}


def test_memo_computes_each_text_once(spark):
    texts = [(i, "u", "same" if i < 50 else f"text {i}", f"k{min(i, 49) if i < 50 else i}") for i in range(60)]
    keyed = spark.createDataFrame(
        [(i, u, c, "k" if c == "same" else k) for i, u, c, k in texts], "id int, url string, content string, memo_key string"
    )
    memo = spark.createDataFrame([("k55", "old", "old")], "memo_key string, title string, summary string")

    def reply(batches):
        for pdf in batches:
            assert "request" in pdf and pdf["request"].str.startswith("URL: u").all()
            failed = pdf["content"].str.endswith("57")
            yield pd.DataFrame(
                {
                    "memo_key": pdf["memo_key"],
                    "title": pdf["content"].where(~failed, "Error processing title"),
                    "summary": pdf["content"].where(~failed, "Error processing summary"),
                    "cost": 0.5, "tokens": 2,
                }
            )

    result = memoised(keyed, memo, ["url", "content"], hooked_titles(reply), "completion", titles_failed())
    rows = result.rows.collect()
    assert len(rows) == 60
    assert {r["title"] for r in rows if r["id"] < 50} == {"same"}
    assert [r["title"] for r in rows if r["id"] == 55] == ["old"]
    assert [r["title"] for r in rows if r["id"] == 57] == ["Error processing title"]
    assert result.usage.count() == 10
    assert {r["memo_key"] for r in result.additions.collect()} == {"k", *[f"k{i}" for i in (50, 51, 52, 53, 54, 56, 58, 59)]}


def test_bad_vectors_from_a_hook_become_zero(spark):
    def reply(batches):
        for pdf in batches:
            yield pd.DataFrame({"memo_key": pdf["memo_key"], "embedding": [[1.0, 2.0], [1.0]], "cost": 0.0, "tokens": 1})

    misses = spark.createDataFrame([("a", "x"), ("b", "y")], "memo_key string, content string").coalesce(1)
    got = {r["memo_key"]: r["embedding"] for r in hooked_vectors(reply, 2)(misses).collect()}
    assert got == {"a": [1.0, 2.0], "b": [0.0, 0.0]}


def test_a_hook_gets_as_few_rows_as_are_asked_for(spark):
    def reply(batches):
        for batch in batches:
            assert len(batch) == 1 and list(batch.index) == [0]
            if batch["content"][0] == "b":
                raise RuntimeError("no answer")
            yield pd.DataFrame({"memo_key": batch["memo_key"], "embedding": [[1.0, 2.0]]})

    misses = spark.createDataFrame([(c, c) for c in "abc"], "memo_key string, content string").coalesce(1)
    got = {r["memo_key"]: (r["embedding"], r["failed"]) for r in hooked_vectors(reply, 2, rows=1)(misses).collect()}
    assert got == {"a": ([1.0, 2.0], False), "b": ([0.0, 0.0], True), "c": ([1.0, 2.0], False)}


def test_native_vectors(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "A, b! a"), (3, "..."), (4, None)], "id int, c string")
    got = {r["id"]: r["v"] for r in df.select("id", hashed_vector(F.col("c"), 32).alias("v")).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6
    assert not any(got[3]) and not any(got[4])


def test_chunk_records(spark):
    chunks = spark.createDataFrame([("https://h/a/b?q", 0, "# Title here\nOne. Two! Three?")], "url string, chunk_number int, content string")
    row = enrich(chunks, T1(), 16).first()
    assert (row["title"], row["summary"]) == ("Title here", "One. Two!")
    assert row["metadata"] == (
        '{"source":"pydantic_ai_docs","chunk_size":29,"crawled_at":"2025-01-01T00:00:00.000000+00:00",'
        '"url_path":"/a/b","file_path":"data/docs/a_b_q.md"}'
    )
    assert native_titles(chunks.withColumn("memo_key", F.lit("k"))).first()["title"] == "Title here"


@pytest.fixture
def store(spark, tmp_path):
    return KnowledgeStore(spark, str(tmp_path / "kb"))


def base_rows(store):
    kb = store.knowledge_base()
    rows = joined_chunks(kb).select("id", "tool_name", "url", "chunk_number", "content", "title").collect()
    report = constraint_report(kb.tool_docs, kb.page, kb.page_chunk, 16)
    assert not report.where("violations > 0").collect()
    return sorted(tuple(r) for r in rows)


def test_ingest_twice_is_ingest_once(spark, store, monkeypatch):
    from docloom.sources import kb_store

    monkeypatch.setitem(kb_store.SEGMENTS, "page_chunk", ("page_id", 2))
    batch = documents(spark, [
        ("a", "https://a/1", "First page. " * 30, 1), ("a", "https://a/1", "Newer page. " * 30, 2),
        ("a", "https://a/2", "Second.", 1), ("b", "https://b/1", "Newer page. " * 30, 1), ("b", "https://b/2", "", 1),
    ])
    def title(batches):
        for pdf in batches:
            yield pd.DataFrame({"memo_key": pdf["memo_key"], "title": "T", "summary": "S", "cost": 0.0, "tokens": 2})

    def vector(batches):
        for pdf in batches:
            yield pd.DataFrame({"memo_key": pdf["memo_key"], "embedding": [[1.0] * 16] * len(pdf), "cost": 0.0, "tokens": 3})

    prices = spark.createDataFrame([("big", 0.5)], "model string, cost_per_token double")
    hooks = {"titles": hooked_titles(title), "vectors": hooked_vectors(vector, 16), "title_model": "big", "prices": prices}
    done = ingest_documents(store, batch, T1(), size=100, width=16, **hooks)
    assert done.rejects.count() == 0
    assert {(r["kind"], r["cost"]) for r in done.usage.collect()} == {("completion", 1.0), ("embedding", 0.0)}
    # The copy on two pages has two titles (its URL counts) but one vector.
    calls = {r["kind"]: r["n"] for r in done.usage.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert calls["completion"] > calls["embedding"]
    first = base_rows(store)
    assert {r[2] for r in first} == {"https://a/1", "https://a/2", "https://b/1"}
    assert not any("First" in r[4] for r in first)
    again = ingest_documents(store, batch, T2(), size=100, width=16, **hooks)
    assert again.usage.count() == 0
    assert base_rows(store) == first
    # A shorter page keeps its old tail unless it is pruned.
    short = documents(spark, [("a", "https://a/1", "Short.", 3), ("c", "https://c/1", "New tool.", 1)])
    ingest_documents(store, short, T2(), size=100, width=16)
    later = base_rows(store)
    assert len(later) == len(first) + 1 and len({r[0] for r in later}) == len(later)
    page = [r for r in store.read("page").collect() if r["url"] == "https://a/1"][0]["id"]
    sizes = spark.createDataFrame([(page, 1)], "page_id long, n_chunks int")
    kept = prune_stale(store.read("page_chunk"), sizes).where(F.col("page_id") == page).collect()
    assert [r["content"] for r in kept] == ["Short."]
    vector = spark.range(1).select(hashed_vector(F.lit("new tool"), 16).alias("v")).first()["v"]
    assert match_chunks(store.knowledge_base(), vector, 1).first()["url"] == "https://c/1"


def test_new_pages_leave_old_segments_alone(spark, store, monkeypatch):
    from docloom.sources import kb_store

    monkeypatch.setitem(kb_store.SEGMENTS, "page", ("id", 2))
    schema = "tool_id long, url string, seq int"
    store.upsert("page", spark.createDataFrame([(1, f"u{i}", 1) for i in range(5)], schema), T1())
    before = {r["segment"]: r["path"] for r in store._manifest()}
    store.upsert("page", spark.createDataFrame([(1, "v", 1)], schema), T2())
    after = {r["segment"]: r["path"] for r in store._manifest()}
    assert {s for s in before if before[s] == after[s]} == {0, 1, 2}
    assert sorted(r["id"] for r in store.read("page").collect()) == [1, 2, 3, 4, 5, 6]


def test_a_commit_writes_its_own_rows_only(spark, store, tmp_path):
    from docloom.sources.storage import folders

    schema = "tool_id long, url string, seq int"
    store.upsert("page", spark.range(3000).selectExpr("1L AS tool_id", "concat('u', id) AS url", "1 AS seq"), T1())
    for i in range(3):
        store.upsert("page", spark.createDataFrame([(1, f"u{i}", 1), (1, f"new{i}", 1)], schema), T2())
    entries = store._entries("page")
    assert [len(rows) for rows in entries.values()] == [4] and [r["base"] for r in entries[0]] == [True, False, False, False]
    assert [spark.read.parquet(r["path"]).count() for r in entries[0]] == [3000, 2, 2, 2]

    def rows():
        return sorted(tuple(r) for r in store.read("page").selectExpr("id", "url", "CAST(updated_at AS date)").collect())

    before = rows()
    assert len(before) == 3003 and [r[0] for r in before] == list(range(1, 3004))
    late = before[-1][2]
    assert {u for _, u, at in before if at == late} == {"u0", "u1", "u2", "new0", "new1", "new2"}
    assert store.compact("page", least=4) == 0 and store.compact("page", least=3) == 1
    assert rows() == before and [len(r) for r in store._entries("page").values()] == [1]
    assert store.vacuum() == 4 and rows() == before
    assert len(folders(f"{store.root}/page")) == 1 and store.vacuum() == 0
    # After a merge, ids go on from the greatest.
    store.upsert("page", spark.createDataFrame([(1, "last", 1)], schema), T2())
    assert rows()[-1][:2] == (3004, "last")


def test_stored_keys_stay_in_place_for_a_small_batch(spark, tmp_path):
    path = str(tmp_path / "stored")
    spark.range(200_000).selectExpr(
        "id", "1L AS tool_id", "concat('u', id) AS url", "current_timestamp() AS created_at", "current_timestamp() AS updated_at"
    ).write.parquet(path)
    wanted = spark.createDataFrame([(1, "u5")], "tool_id long, url string")
    plan = spark.read.parquet(path).select("tool_id", "url", "id").join(wanted, ["tool_id", "url"])
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text.split("Initial Plan")[0]


def test_hooks_lose_no_chunk(spark):
    def titles(batches):
        for pdf in batches:
            if pdf["content"].str.contains("raise").any():
                raise ValueError("down")
            kept = pdf[~pdf["content"].str.contains("skip")]
            half = kept["content"].str.contains("half")
            yield pd.DataFrame(
                {"memo_key": kept["memo_key"], "title": "t", "summary": pd.Series("s", kept.index).where(~half, None), "cost": 1.0, "tokens": 1}
            )

    rows = [(f"k{i}", "u", text) for i, text in enumerate(["fine", "skip", "half", "raise"])]
    misses = spark.createDataFrame(rows, "memo_key string, url string, content string").repartition(4, "memo_key")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        memo = spark.createDataFrame([], "memo_key string, title string, summary string")
        result = memoised(misses, memo, ["url", "content"], hooked_titles(titles), "completion", titles_failed())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    got = {r["content"]: (r["title"], r["summary"]) for r in result.rows.collect()}
    fallback = ("Error processing title", "Error processing summary")
    assert got == {"fine": ("t", "s"), "skip": fallback, "half": fallback, "raise": fallback}
    assert [r["memo_key"] for r in result.additions.collect()] == ["k0"]


def test_a_key_twice_in_the_memo_counts_once(spark):
    keyed = spark.createDataFrame([(1, "k", "u", "c")], "id int, memo_key string, url string, content string")
    memo = spark.createDataFrame([("k", "t", "s"), ("k", "t", "s")], "memo_key string, title string, summary string")
    result = memoised(keyed, memo, ["url", "content"], hooked_titles(lambda x: x), "completion", titles_failed())
    assert result.rows.count() == 1


def test_captures_are_read_once(spark, store):
    from docloom.plans.packages import captured

    redirects = spark.createDataFrame([("https://a/old", "https://a/1")], "url string, final_url string")
    page = "<h1>{}</h1><a href='/2'>two</a><a href='https://b/x'>out</a>"
    rows = [("https://a/1", page.format("One")), ("https://a/old", page.format("One")), ("https://a/3", None)]
    first = captured(store, spark.createDataFrame(rows, "url string, html string"), redirects)
    got = {r["url"]: (r["final_url"], r["content"], [x["href"] for x in r["links"]]) for r in first.collect()}
    text = ("https://a/1", "# One\n\ntwoout", ["https://a/2"])
    assert got == {"https://a/1": text, "https://a/old": text, "https://a/3": ("https://a/3", None, [])}
    later = [("https://a/1", page.format("Changed")), ("https://a/4", "<p>New</p>")]
    again = captured(store, spark.createDataFrame(later, "url string, html string"), redirects)
    assert {r["url"]: r["content"] for r in again.collect()} == {"https://a/1": "# One\n\ntwoout", "https://a/4": "New"}
    assert store.memo("capture").count() == 4


def test_pages_that_are_not_cached_are_read_anew(spark, store):
    from docloom.plans.packages import captured

    redirects = spark.createDataFrame([], "url string, final_url string")
    schema = "url string, html string, cached boolean"
    rows = [("https://a/1", "<p>one</p>", True), ("https://b/1", "<p>one</p>", False)]
    captured(store, spark.createDataFrame(rows, schema), redirects).count()
    later = [("https://a/1", "<p>two</p>", True), ("https://b/1", "<p>two</p>", False)]
    again = captured(store, spark.createDataFrame(later, schema), redirects)
    assert {r["url"]: r["content"] for r in again.collect()} == {"https://a/1": "one", "https://b/1": "two"}
    assert [r["url"] for r in store.memo("capture").collect()] == ["https://a/1"]


def test_lookups_read_the_folders_of_their_keys_only(spark, store):
    from docloom.operators.enrichment import MEMO_PART, memo_hits, memo_part

    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("memo_key"), F.lit("t").alias("title"), F.lit("s").alias("summary"))
    store.remember("title", rows)
    store.remember("title", rows.where("memo_key = 'k7'"))
    keyed = spark.createDataFrame([("k7",), ("k7",), ("none",)], "memo_key string")
    hits = memo_hits(keyed, store.memo("title"))
    assert [tuple(r) for r in hits.collect()] == [("k7", "t", "s")]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    wanted = {r[0] for r in keyed.select(memo_part(F.col("memo_key"))).distinct().collect()}
    assert len(wanted) == 2 and f"PartitionFilters: [{MEMO_PART}" in plan


def test_capture_lines_that_are_broken_are_rejected(spark):
    from docloom.sources.captures import read_capture_lines

    link = '{"href": "/x", "text": "t", "title": "more"}'
    lines = [
        '{"url": "https://a/", "final_url": "https://a/end", "markdown_v2": {"raw_markdown": "# A", "fit_markdown": ""},'
        f' "links": {{"internal": [{link}], "external": []}}, "status_code": 200}}',
        '{"url": "https://b/", "markdown_v2": null, "links": {}}', '{"url": "https://b/", "final_url": ""}',
        "", "   ", '{"url": "https://c/"', '{"url": 3, "links": "x"}', "[]", "no json", '{"url": ""}', '{"final_url": "https://d/"}', "null",
    ]
    good, rejects = read_capture_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r["url"], r["final_url"], r["content"], [x["href"] for x in r["links"]]) for r in good.collect()] == [
        ("https://a/", "https://a/end", "# A", ["/x"]), ("https://b/", "https://b/", None, []), ("https://b/", "https://b/", None, []),
    ]
    got = [tuple(r) for r in rejects.collect()]
    assert {x for x, _ in got} == set(lines[5:]) and all(reason in ("broken record", "no URL") for _, reason in got)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.org/p{i}#x", f"<title>t</title><h1>Page {i}</h1><p>Text of {i}. More.</p>") for i in range(9)]
    folder = tmp_path / "pages"
    for part in range(3):
        df = spark.createDataFrame(rows[part * 3 : part * 3 + 3], "page_id long, url string, html string")
        df.coalesce(1).write.mode("append").parquet(str(folder))
    stream = page_stream(spark, str(folder)).select("page_id", "url", "html")
    streamed = KnowledgeStore(spark, str(tmp_path / "streamed"))
    progress = str(tmp_path / "progress")
    start_ingest(stream, streamed, progress, T1(), width=16).awaitTermination()
    got = [(t, u, n, c) for _, t, u, n, c, _ in base_rows(streamed)]
    assert sorted(got) == sorted(
        (f"h{i % 3}.org", f"https://h{i % 3}.org/p{i}", 0, f"# Page {i}\n\nText of {i}. More.") for i in range(9)
    )
    start_ingest(stream, streamed, progress, T2(), width=16).awaitTermination()
    assert [(t, u, n, c) for _, t, u, n, c, _ in base_rows(streamed)] == got


def test_files_take_the_last_page_of_a_name(spark, tmp_path):
    rows = [(1, "https://a/docs/x", "one"), (2, "https://b/docs/x", "two"), (3, "https://a/", "root")]
    files = document_files(spark.createDataFrame(rows, "page_id long, url string, content string"), "page_id")
    write_documents(files, str(tmp_path / "files"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "files")).collect()}
    assert got == {("data/docs/docs_x.md", "two"), ("data/docs/index.md", "root")}


def test_catalog_and_usage(spark):
    tools = spark.createDataFrame(
        [(1, "full", "s", "u1"), (2, "none", "s", "u2"), (3, "one", "s", "u3")], "id long, tool_name string, source_type string, url string"
    )
    pages = spark.createDataFrame([(1,), (1,), (3,)], "tool_id long")
    rows = catalog.tool_catalog(tools, pages)
    assert [(r["tool_name"], r["page_count"]) for r in rows.collect()] == [("full", 2), ("none", 1), ("one", 1)]
    assert catalog.catalog_line(rows).first()["line"] == (
        "Available tools: full (s, 2 pages from u1), none (s, 1 pages from u2), one (s, 1 pages from u3)"
    )
    calls = spark.createDataFrame([("completion", "m", 10), ("completion", "x", 5)], "kind string, model string, tokens int")
    prices = spark.createDataFrame([("m", 0.01)], "model string, cost_per_token double")
    usage = catalog.priced(calls, prices)
    assert catalog.usage_summary(usage).first()["summary"].splitlines() == [
        "=== Cost and Token Usage Summary ===", "Completion Cost: $0.100000", "Embedding Cost: $0.000000",
        "Total Cost: $0.100000", "", "Completion Tokens: 15", "Embedding Tokens: 0", "Total Tokens: 15",
    ]
    assert {r["kind"]: r["tokens"] for r in catalog.usage_totals(usage).collect()} == {"completion": 15, "total": 15}
