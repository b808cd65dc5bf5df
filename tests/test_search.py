from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.vectors import cosine_similarity
from docloom.operators import ivf, topk
from docloom.operators.answers import accepted_answers, best_questions
from docloom.operators.search import (
    KnowledgeBase,
    context_pack,
    match_chunks,
    match_chunks_batch,
    nearest,
    search_result,
)

NAN = float("nan")


def vectors(n, width=8, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, width)).astype(np.float32)


@pytest.fixture(scope="module")
def kb(spark):
    tools = [(1, "a", "official_package_documentation", '{"version":"1"}'), (2, "b", "official_package_documentation", '{"version":"2"}')]
    pages = [(i, 1 + i % 2, f"https://h/{i}") for i in range(10)]
    data = vectors(20)
    chunks = []
    for i in range(20):
        vector = None if i == 3 else [0.0] * 8 if i == 4 else data[5 if i == 6 else i].tolist()
        chunks.append((i, i // 2, i % 2, f"t{i}", f"s{i}", f"c{i}", vector, "{}"))
    return KnowledgeBase(
        spark.createDataFrame(tools, "id long, tool_name string, source_type string, metadata string"),
        spark.createDataFrame(pages, "id long, tool_id long, url string"),
        spark.createDataFrame(
            chunks,
            "id long, page_id long, chunk_number int, title string, summary string, content string,"
            " embedding array<float>, metadata string",
        ),
    )


def ordered_ids(query, keep=lambda i: True):
    data = vectors(20)

    def key(i):
        if i in (3, 4):
            return (7 - i, 0, i)
        v = data[5 if i == 6 else i].astype(float)
        return (0, round(1 - float(v @ query / np.linalg.norm(v) / np.linalg.norm(query)), 12), i)

    return sorted((i for i in range(20) if keep(i)), key=key)


def test_order_is_numbers_then_nan_then_null(kb):
    query = vectors(1, seed=9)[0].astype(float)
    rows = match_chunks(kb, query.tolist(), 20).collect()
    assert [r["id"] for r in rows] == ordered_ids(query)
    assert math.isnan(rows[-2]["similarity"]) and rows[-1]["similarity"] is None
    assert [r["id"] for r in match_chunks(kb, query.tolist(), 3).collect()] == ordered_ids(query)[:3]


@pytest.mark.parametrize("most", [3, 250_000])
def test_many_matches_are_joined(kb, monkeypatch, most):
    from docloom.operators import search

    query = vectors(1, seed=9)[0].astype(float)
    monkeypatch.setattr(search, "BROADCAST_HITS", most)
    assert [r["id"] for r in match_chunks(kb, query.tolist(), 20).collect()] == ordered_ids(query)


def test_default_number_of_matches(kb):
    assert match_chunks(kb, vectors(1, seed=9)[0].tolist()).count() == 10


def test_filter_is_on_the_tool(kb):
    query = vectors(1, seed=9)[0].astype(float)
    rows = match_chunks(kb, query.tolist(), 20, {"version": "2"}).collect()
    assert [r["id"] for r in rows] == ordered_ids(query, lambda i: (i // 2) % 2 == 1)
    assert {r["tool_name"] for r in rows} == {"b"}


def test_result_columns(kb):
    row = search_result(match_chunks(kb, vectors(1, seed=9)[0].tolist(), 1)).first()
    assert list(row.asDict()) == [
        "title", "source_url", "tool_name", "source_type", "summary", "similarity", "chunk_number", "content",
    ]


def test_wrong_width_is_an_error(kb):
    with pytest.raises(Exception, match="different vector dimensions"):
        match_chunks(kb, [1.0, 2.0], 3).collect()


@pytest.mark.parametrize(("block", "size"), [(2048, 1 << 20), (3, 1 << 20), (1, 1 << 20), (2048, 40)])
def test_batch_equals_one_by_one(spark, kb, monkeypatch, block, size):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk, "BLOCK_BYTES", size)
    queries = vectors(7, seed=9)
    table = spark.createDataFrame(
        [(i, q.tolist()) for i, q in enumerate(queries)], "query_id long, vector array<float>"
    )
    got = match_chunks_batch(kb, table, 20).collect()
    for i, q in enumerate(queries):
        mine = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == i)
        assert [r for r, _ in mine] == list(range(1, 21))
        assert [x for _, x in mine] == ordered_ids(q.astype(float))


def test_plan_does_not_grow_with_the_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, i / 9]) for i in range(40)], "query_id long, vector array<float>")
    plans, rows = [], []
    for block in (100, 8, 2):
        monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
        got = nearest(items, queries, 3)
        plans.append(len(got._jdf.queryExecution().analyzed().toString().splitlines()))
        rows.append(sorted(map(tuple, got.collect())))
    assert len(set(plans)) == 1 and rows[0] == rows[1] == rows[2] and len(rows[0]) == 120


def test_items_are_made_once_for_all_blocks(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def vector(i):
        made.add(1)
        return [1.0, float(i)]

    items = spark.range(30).select("id", vector.asNondeterministic()("id").alias("embedding"))
    queries = spark.createDataFrame([(i, [1.0, i / 9]) for i in range(40)], "query_id long, vector array<float>")
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk, "VECTOR_BLOCKS", 1)
    assert nearest(items, queries, 3).count() == 120
    assert made.value == 30
    made.value = 0
    assert ivf.search(ivf.build(items, centres=np.eye(2)), queries, 3, probes=2).count() == 120
    assert made.value == 30


@pytest.mark.parametrize("k", [1, 4, 300])
def test_screened_vectors_are_those_of_all_keys(k):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    near = vectors(40)[rng.integers(0, 40, 900)].astype(float) + rng.normal(size=(900, 8)) * rng.choice([0, 1e-9, 1e-6, 1e-3], (900, 1))
    rows = near.tolist()
    for i, odd in ((3, None), (50, None), (700, [0.0] * 8), (701, [0.0] * 8), (702, [NAN] * 8), (703, [float("inf")] * 8)):
        rows[i] = odd
    queries = np.vstack([near[:200], near[:5] * 1e150, np.zeros((2, 8)), np.full((2, 8), NAN), [[float("inf"), *[0] * 7]]])
    ids, column = rng.permutation(900) % 890, pa.array(rows, pa.list_(pa.float64()))
    plain, fast = topk.Best(len(queries), k), topk.Nearest(queries, k, 9)
    for at in range(0, 900, 300):
        part = column.slice(at, 300)
        with np.errstate(invalid="ignore"):
            plain.add(None, topk.cosine_keys(queries, part, 9), ids[at : at + 300])
            fast.visit(None, part, ids[at : at + 300])
    assert (plain.ids == fast.ids).all()
    assert np.allclose(np.minimum(plain.keys, 9), np.minimum(fast.keys, 9), rtol=0, atol=2e-9)


def test_a_query_without_direction_gets_its_lists_first_ids(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id long, embedding array<float>")
    index = ivf.build(items, centres=np.array([[1.0, 0.0], [0.0, 1.0]]))
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in ivf.search(index, queries, 2, probes=2).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 1)]


def test_copies_tie_by_id(spark):
    items = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000, 0, -1)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vector array<float>")
    got = nearest(items.repartition(7), queries, 4).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4]


def test_missing_query_vector_gives_null(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, None), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in nearest(items, queries, 2).collect()}
    assert got[1, 1] == (0, None) and got[1, 2] == (1, None) and got[2, 1][0] == 4


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], NAN), (None, [1.0], None)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    for got, want in df.select(cosine_similarity(F.col("a"), F.col("b")), "want").collect():
        assert got == want or (math.isnan(got) and math.isnan(want))


def test_context_pack(spark):
    rows = [(1, 2, "u1", "t2", "c2"), (1, 1, "u1", "t1", "c1"), (1, 3, "u2", "t3", "c3")]
    df = spark.createDataFrame(rows, "query_id long, rank int, url string, title string, content string")
    row = context_pack(df).first()
    assert row["content"] == "## t1\nu1\n\nc1\n\n## t2\nu1\n\nc2\n\n## t3\nu2\n\nc3"
    assert row["reference_urls"] == ["u1", "u2"]


def test_inverted_lists(spark, tmp_path):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(200))] + [(900, None), (901, [0.0] * 8)]
    items = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = items.where("id < 20").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    ivf.write_index(ivf.build(items, lists=6), str(tmp_path / "index"))
    index = ivf.read_index(spark, str(tmp_path / "index"))
    assert index.rows.count() == 200
    plan = index.rows.where("list_id = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan
    exact = {(r["query_id"], r["rank"], r["id"]) for r in nearest(items, queries, 5).collect()}
    assert {(r["query_id"], r["rank"], r["id"]) for r in ivf.search(index, queries, 5, probes=6).collect()} == exact
    near = ivf.search(index, queries, 1, probes=1).collect()
    assert {(r["query_id"], r["id"]) for r in near} == {(i, i) for i in range(20)}
    assert all(0.2 <= r["recall"] <= 1 for r in ivf.recall(index, queries, 5, 1).collect())


def bm25(texts, query):
    import re

    docs = {i: re.findall(r"\w+", t.lower()) for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for i, words in docs.items():
        total = 0.0
        for w in set(re.findall(r"\w+", query.lower())):
            n = sum(w in d for d in docs.values())
            tf = words.count(w)
            idf = math.log(1 + (len(docs) - n + 0.5) / (n + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if total:
            scores[i] = total
    return scores


@pytest.mark.parametrize("cells", [4_000_000, 50])
def test_best_question_by_bm25(spark, monkeypatch, cells):
    from docloom.operators import answers

    rng = random.Random(5)
    words = ["the"] * 6 + [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(1, 20))) for i in range(60)}
    asked = {i: " ".join(rng.choices(words, k=5)) for i in range(15)} | {99: "unknown words"}
    monkeypatch.setattr(answers, "PACK_WORDS", 8)
    monkeypatch.setattr(answers, "COUNT_CELLS", cells)
    got = best_questions(
        spark.createDataFrame(list(texts.items()), "question_id long, title string").repartition(5),
        spark.createDataFrame(list(asked.items()), "query_id long, query string"),
        k=3,
    ).collect()
    for i, query in asked.items():
        scores = bm25(texts, query)
        wanted = sorted(scores, key=lambda q: (-round(scores[q], 9), q))[:3]
        mine = sorted((r["rank"], r["question_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [q for _, q, _ in mine] == wanted
        assert all(abs(s - scores[q]) < 1e-8 for _, q, s in mine)


def test_accepted_answers(spark):
    questions = [(1, "how to sort a list", 11), (2, "how to sort a list fast", None), (3, "join tables", 13)]
    got = accepted_answers(
        spark.createDataFrame(questions, "question_id long, title string, accepted_answer_id long"),
        spark.createDataFrame([(11, "use sort"), (12, "x"), (13, "use join")], "answer_id long, body string"),
        spark.createDataFrame([(1, "sort list fast"), (2, "nothing here")], "query_id long, query string"),
    ).collect()
    assert {tuple(r) for r in got} == {
        (1, "how to sort a list", "use sort", "https://stackoverflow.com/q/1"), (2, None, None, None),
    }


def test_search_from_sql_equals_the_function(spark, kb):
    from docloom.operators.sql_search import register_search

    name = register_search(spark, kb, "match_test")
    query = vectors(1, seed=9)[0].tolist()
    literal = f"CAST(array({', '.join(f'{x!r}D' for x in query)}) AS ARRAY<FLOAT>)"
    for arguments, count, wanted in ((", 7", 7, None), (", 20", 20, None), ("", 10, None), (", 20, map('version', '2')", 20, {"version": "2"})):
        called = spark.sql(f"SELECT * FROM {name}({literal}{arguments}) ORDER BY similarity DESC, id")
        plain = match_chunks(kb, query, count, wanted)
        assert called.columns == plain.columns
        key = lambda r: (r["id"], str(round(r["similarity"], 9) if r["similarity"] is not None else None), r["url"], r["tool_name"])
        assert sorted(map(key, called.collect())) == sorted(map(key, plain.collect()))
    assert spark.sql(f"SELECT * FROM {name}({literal}, 5, map('none', 'x'))").count() == 0
    # The count of a call becomes a top-k of the scan, not a sort of all rows in one task.
    plan = spark.sql(f"SELECT * FROM {name}({literal}, 7)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=7" in plan
    with pytest.raises(Exception, match="different vector dimensions"):
        spark.sql(f"SELECT * FROM {name}(array(1F, 2F))").collect()
