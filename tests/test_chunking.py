from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import WHITESPACE, strip
from docloom.operators.chunking import chunk_documents, chunk_text


def chunks_of(spark, text, size):
    df = spark.createDataFrame([(text,)], "content string")
    return df.select(chunk_text(F.col("content"), size).alias("c")).first()["c"]


def test_long_text_keeps_to_the_size(spark):
    chunks = chunks_of(spark, "This is a test." * 1000, 100)
    assert len(chunks) > 1
    assert all(len(c) <= 100 for c in chunks)


def test_fences_stay_whole(spark):
    block = "\nText before.\n```python\ndef f():\n    print('code')\n    return True\n```\nText after.\n"
    chunks = chunks_of(spark, block * 10, 200)
    assert not any(c.count("```") == 1 for c in chunks)


def test_unclosed_fence_runs_to_the_end(spark):
    text = "a" * 50 + "```" + "b. " * 200
    assert chunks_of(spark, text, 100) == [text.strip()]


def test_paragraphs_are_cut_at_blank_lines(spark):
    text = "One.\nTwo lines.\n\nThree.\nFour lines here.\n\nFive.\n" * 10
    assert len(chunks_of(spark, text, 100)) > 5
    lone = "x" * 60 + "\n\n" + "y" * 60
    assert chunks_of(spark, lone, 100) == ["x" * 60, "y" * 60]


def test_blank_line_hides_sentences(spark):
    text = "a\n\n" + "b" * 60 + ". " + "c" * 80
    assert chunks_of(spark, text, 100)[0] == text[:100]


def test_sentences_end_with_a_stop(spark):
    chunks = chunks_of(spark, "This is sentence one. This is sentence two. And three. " * 50, 100)
    assert all(c.endswith(".") for c in chunks[:-1])


def test_small_last_window_can_be_cut(spark):
    text = "a" * 40 + ". " + "b" * 10
    assert chunks_of(spark, text, 100) == ["a" * 40 + ".", "b" * 10]


@pytest.mark.parametrize(
    "text, expected", [("", []), (" \n ", []), ("This is small.", ["This is small."])]
)
def test_small_inputs(spark, text, expected):
    assert chunks_of(spark, text, 1000) == expected


def test_chunks_are_stripped(spark):
    text = "   Line   \n\n   Another   \n\n   Third   "
    assert all(c == c.strip() for c in chunks_of(spark, text, 20))


def test_whitespace_is_that_of_strip(spark):
    assert all(c.isspace() for c in WHITESPACE)
    assert {chr(c) for c in range(0x110000) if chr(c).isspace()} == set(WHITESPACE)
    df = spark.createDataFrame([(WHITESPACE + "x y" + WHITESPACE,)], "s string")
    assert df.select(strip(F.col("s"))).first()[0] == "x y"


def expected_chunks(text, size):
    """The rules, said once more with regular expressions on plain strings."""
    import re

    out = []
    while text:
        window = text[:size]
        marks = len(re.findall("```", window))
        blank = [m.start() for m in re.finditer("(?=\n\n)", window)]
        stops = [m.start() + 1 for m in re.finditer(r"(?=\. )", window)]
        take = len(window)
        if marks % 2:
            closing = re.search("```", text[size:])
            take = size + closing.end() if closing else len(text)
        elif blank:
            take = blank[-1] if blank[-1] > 0.3 * size else take
        elif stops and stops[-1] - 1 > 0.3 * size:
            take = stops[-1]
        out.append(text[:take].strip())
        text = text[take:]
    return [c for c in out if c]


def test_random_texts(spark):
    rng = random.Random(7)
    pieces = ["word ", "é", ". ", "\n", "\n\n", "```", "```\n", "  ", "ünder", ".", " ", "漢字", "😀"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 120))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for size in (10, 37, 100):
        got = {
            r["id"]: r["c"] for r in df.select("id", chunk_text(F.col("content"), size).alias("c")).collect()
        }
        for i, text in enumerate(texts):
            assert got[i] == expected_chunks(text, size), (size, text)


def test_chunks_cover_all_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chunks = chunk_documents(documents, "text", 1000).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_number", "content"))).alias("c")
    )
    for row in chunks.join(documents, "doc_id").collect():
        assert [c["chunk_number"] for c in row["c"]] == list(range(len(row["c"])))
        position = 0
        for c in row["c"]:
            found = row["text"].index(c["content"], position)
            assert not row["text"][position:found].strip()
            position = found + len(c["content"])
        assert not row["text"][position:].strip()
