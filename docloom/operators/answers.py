"""Best question with an accepted answer for each query, by BM25."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import words
from docloom.operators.topk import NO_MATCH, Scores, Shared, scan, top_k
from docloom.session import cut_lineage

# Tasks get this module's code with their closures; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1 = 1.2
B = 0.75
SCORE_DECIMALS = 9
# One dense query matrix has at most this many words (or one query).
PACK_WORDS = 4096
# And so many numbers, 8 MB; the matrix is made in the task, from the weights that are not zero.
PACK_CELLS = 1 << 20
COUNT_CELLS = 4_000_000


# What a word of a query takes in a pack: its letters, its place, and its weight.
TERM_BYTES = 64


def _with_terms(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct words of each query with the number of questions that hold them.

    Only words that a query holds are counted.
    """
    asked = cut_lineage(
        queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("word"))
    )
    found_in = (
        tokens.select(F.explode(F.array_distinct("tokens")).alias("word"))
        .join(asked.select("word").distinct(), "word", "left_semi")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    return (
        asked.join(found_in, "word")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("word", "n")).alias("terms"))
    )


def _packs(block: list, total: int) -> list[tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Queries in packs of ``(rows, vocabulary, word, query, weight)``, a weight for each word of each query."""
    packs, rows, held = [], [], 0
    for row, query in enumerate(block):
        more = held + len(query["terms"])
        if rows and (more > PACK_WORDS or more * (len(rows) + 1) > PACK_CELLS):
            packs.append(rows)
            rows, more = [], len(query["terms"])
        rows.append(row)
        held = more
    packs.append(rows)
    out = []
    for rows in packs:
        counts = {t["word"]: t["n"] for r in rows for t in block[r]["terms"]}
        position = {word: i for i, word in enumerate(counts)}
        placed = [(position[t["word"]], column, t["n"]) for column, r in enumerate(rows) for t in block[r]["terms"]]
        word, query, found = np.array(placed, dtype=np.int64).reshape(-1, 3).T
        out.append((np.array(rows), list(counts), word, query, np.log(1 + (total - found + 0.5) / (found + 0.5))))
    return out


def _matrix(words_: int, queries: int, word: np.ndarray, query: np.ndarray, weight: np.ndarray) -> np.ndarray:
    weights = np.zeros((words_, queries))
    weights[word, query] = weight
    return weights


def best_questions(questions: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """``(query_id, rank, question_id, score)``: the k questions that match a query best.

    ``questions(question_id, title)``, ``queries(query_id, query)``. Questions
    that share no word with a query are no match for it. A word that most
    questions hold costs no join: tasks score their questions against a block
    of queries and keep the best.
    """
    # Questions are split into words once, for the totals, the counts and the scan.
    tokens = cut_lineage(
        questions.select(F.col("question_id").alias("id"), words(F.col("title")).alias("tokens"))
    )
    size = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean")).first()
    total, mean = size["n"], size["mean"] or 1.0

    def scan_block(block: list, share: Shared) -> DataFrame:
        ids = np.array([row["query_id"] for row in block], dtype=np.int64)
        shared = share(_packs(block, total))

        def score(batch: pa.RecordBatch) -> Scores:
            for rows, vocabulary, *places in shared.value:
                weights = _matrix(len(vocabulary), len(rows), *places)
                step = max(1, COUNT_CELLS // len(vocabulary))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    scores = _scores(part.column("tokens"), vocabulary, weights, mean)
                    keys = np.where(scores > 0, -np.round(scores, SCORE_DECIMALS), NO_MATCH)
                    yield rows, keys.T, part.column("id").to_numpy()

        return scan(tokens, ids, k, score)

    ranked = top_k(_with_terms(queries, tokens), k, F.size("terms") * TERM_BYTES, scan_block)
    return ranked.select(
        "query_id", "rank", F.col("item_id").alias("question_id"), (-F.col("rank_key")).alias("score")
    )


def _scores(
    tokens: pa.ListArray, vocabulary: list[str], weights: np.ndarray, mean: float
) -> np.ndarray:
    """BM25 ``[question, query]`` of one batch of tokenised questions."""
    rows, width = len(tokens), len(vocabulary)
    lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
    code = pc.index_in(tokens.flatten(), value_set=pa.array(vocabulary, tokens.type.value_type))
    known = code.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(rows), lengths)[known]
    cells = row * width + code.drop_null().to_numpy()
    tf = np.bincount(cells, minlength=rows * width).reshape(rows, width)
    damping = K1 * (1 - B + B * lengths / mean)
    return (tf * (K1 + 1) / (tf + damping[:, None])) @ weights


def accepted_answers(questions: DataFrame, answers: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, question, accepted_answer, source_url)``; NULLs where nothing matches.

    ``questions(question_id, title, accepted_answer_id)``, ``answers(answer_id, body)``.
    """
    accepted = questions.where(F.col("accepted_answer_id").isNotNull())
    best = best_questions(accepted, queries).select("query_id", "question_id")
    found = (
        accepted.join(best, "question_id")
        .join(answers.withColumnRenamed("answer_id", "accepted_answer_id"), "accepted_answer_id")
        .select(
            "query_id",
            F.col("title").alias("question"),
            F.col("body").alias("accepted_answer"),
            F.concat(F.lit("https://stackoverflow.com/q/"), F.col("question_id").cast("string"))
            .alias("source_url"),
        )
    )
    return queries.select("query_id").join(found, "query_id", "left")
