"""Inputs of the registered queries at sizes that the given tables do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators.chunking import chunk_documents
from docloom.plans import derived as d


def test_ids_of_a_text_with_over_a_thousand_chunks(spark):
    text = "Some words of a sentence here. " * 4000
    docs = spark.createDataFrame([(0, text), (1, text)], "doc_id long, text string")
    chunks = chunk_documents(docs, "text", 100).withColumn("id", d.chunk_id())
    counts = chunks.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("chunk_number").alias("last")).first()
    assert counts["n"] == counts["ids"] and counts["last"] > 1000


def test_a_conversation_of_over_a_thousand_turns(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c}/{t}") for c in range(3) for t in range(2001)]
    questions, answers = d.questions_and_answers(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    )
    found = questions.join(answers, F.col("accepted_answer_id") == F.col("answer_id"), "left").collect()
    assert len(found) == 3 * 1001
    for row in found:
        conv, turn = map(int, row["title"].split("/"))
        assert row["body"] == (f"{conv}/{turn + 1}" if turn < 2000 else None)
