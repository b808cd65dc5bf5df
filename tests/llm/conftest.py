"""Documents with every oddity the operators must stand."""

from __future__ import annotations

import random

import pytest

from docloom.llm.common import prepare

WORDS = "the of and in lantern harbour window garden river stone quiet evening letter morning winter under".split()


def prose(seed: int, words: int = 60) -> str:
    random_ = random.Random(seed)
    text = [random_.choice(WORDS) for _ in range(words)]
    return ". ".join(" ".join(text[i : i + 9]).capitalize() for i in range(0, words, 9)) + "."


# doc_id, text, lang, source
ODD = [
    (1, prose(1), "en", "a"),
    (2, prose(2), "en", "a"),
    (2, prose(2), "en", "a"),  # a repeated row
    (3, prose(1), "en", "b"),  # a copy
    (4, None, "en", "b"),
    (5, "", "en", None),
    (6, " \t\n", None, None),
    (7, "12 345 !?", "en", "c"),
    (None, prose(3), "en", "c"),
    (None, None, None, None),
    (8, "x" * 1_500_000, "en", "c"),  # a word longer than a segment
    (9, (prose(4, 20_000) + "\n") * 12, "en", "c"),  # longer than a segment
    (10, "Привет мир, как дела", "ru", "c"),
    (11, "word", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# Names that operators use inside.
CLASHES = ("_maybe", "_block", "_key", "print", "part", "root", "size", "rank", "component_id", "_kept", "_hash", "held_id")


@pytest.fixture(scope="session")
def lines(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd(lines):
    from pyspark.sql import functions as F

    rows = lines.createDataFrame(ODD, SCHEMA)
    return rows.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def empty(lines):
    return lines.createDataFrame([], SCHEMA)
