"""Toxicity: units, kernel and machine against plain forms; insults with gaps and inserted letters; odd documents."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.llm import toxicity
from docloom.llm.chars import code_points
from tests.llm.conftest import ODD, WORDS

INSULTS = ["blockhead", "nitwit", "scoundrel", "dimwit"]


def letters(word: str) -> bytes:
    return bytes([toxicity.BEGIN, *toxicity.classes()[code_points(word)].tolist()])


def spelled(text: str) -> list[tuple[str, int]]:
    codes = code_points(text)
    u = toxicity.units(codes, np.array([len(codes)]))
    plain = lambda b: "".join("^" if x == toxicity.BEGIN else chr(97 + x) if x < 26 else "?" for x in b)
    return list(zip(map(plain, toxicity.spell(u)), u.sentence.tolist(), strict=True))


def test_units_are_words_runs_of_short_words_and_windows():
    assert spelled("Hello you.No stop. N i t-w i t! Été\nd-i.m*wit") == [
        ("^hello", 0), ("^youno", 0), ("^stop", 0), ("^nitwit", 1), ("^ete", 2), ("^dimwit", 3),
    ]
    long = "".join(chr(97 + i * 7 % 26) for i in range(70))
    windows = [w for w, _ in spelled(long)]
    assert all(len(w) <= toxicity.UNIT for w in windows)
    assert windows[0][1:] == long[: toxicity.UNIT - 1] and long.endswith(windows[-1])
    assert all(any(long[i : i + toxicity.STRIDE] in w for w in windows) for i in range(len(long) - toxicity.STRIDE + 1))


def test_chunks_hold_all_letters_of_all_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    texts = pd.Series(["some words here. " * 9, None, "", "x", "a b\n" * 30, "end"])
    got = {}
    for codes, ends, numbers in toxicity.chunks(texts):
        u = toxicity.units(codes, ends)
        for word, sentence in zip(toxicity.spell(u), u.sentence, strict=True):
            number = int(numbers[u.text_of[sentence]])
            got[number] = got.get(number, 0) + len(word) - 1
    assert got == {i: sum(c.isalpha() for c in t) for i, t in texts.items() if t}


def plain_kernel(one: bytes, other: bytes) -> float:
    """Shared subsequences of three letters, by their definition, over the lengths of units without repeats."""
    def terms(word):
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    key = word[i], word[j], word[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    def norm(n):
        return sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + toxicity.SPAN))) ** 0.5

    a, b = terms(one), terms(other)
    return sum(v * b.get(key, 0) for key, v in a.items()) / norm(len(one)) / norm(len(other))


def test_kernel_and_folded_weights_equal_the_definition():
    marks = [letters(w) for w in ("nitwit", "dimwit", "lantern", "garden")]
    words = [letters(w) for w in ("nitwit", "nixtwit", "nxixtxwxit", "window", "gardens", "wit")]
    landmarks = toxicity.Landmarks(marks)
    plain = np.array([[plain_kernel(w, m) for m in marks] for w in words])
    assert np.allclose(landmarks.kernel(words), plain, atol=1e-5)
    # Whitened features of the landmarks give back their kernel: the Nyström map is exact on them.
    own = landmarks.features(marks)
    assert np.allclose(own @ own.T, landmarks.kernel(marks), atol=1e-4)
    beta = np.random.default_rng(1).normal(size=own.shape[1])
    text = "nitwit nixtwit nxixtxwxit window gardens wit"
    codes = code_points(text)
    u = toxicity.units(codes, np.array([len(codes)]))
    assert np.allclose(toxicity.reached(u, landmarks.fold(beta)), landmarks.features(words) @ beta, atol=1e-3)
    assert plain[0, 0] > plain[1, 0] > plain[2, 0] > plain[3, 0]


def test_machine_separates_and_regression_is_calibrated():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3))
    y = np.where(x[:, 0] - 0.5 * x[:, 1] > 0.2, 1.0, -1.0)
    beta = toxicity.machine(x, y, np.full(400, 1 / 400))
    assert (np.sign(x @ beta[:-1] + beta[-1]) == y).mean() > 0.97
    z = np.column_stack([np.ones(4000), r.normal(size=(4000, 4))])
    p = 1 / (1 + np.exp(-(z @ np.array([-1, 2, 0, 0, 0]))))
    fitted = toxicity.logistic(z, (r.random(4000) < p).astype(float))
    assert np.allclose(fitted, [-1, 2, 0, 0, 0], atol=0.25)


def write(r: random.Random, insults: list[str]) -> str:
    words = [r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(60)]
    for insult in insults:
        words.insert(r.randrange(len(words)), insult)
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."


@pytest.fixture(scope="module")
def learnt(lines):
    r = random.Random(5)
    rows = [(i, write(r, [r.choice(INSULTS) for _ in range(3)] if i % 4 == 0 else []), int(i % 4 == 0)) for i in range(600)]
    labels = [(i, label) for i, _, label in rows] + [(0, 1), (None, 1), (9999, 1), (1, None), (2, 7)]
    docs = lines.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return toxicity.fit(docs, lines.createDataFrame(labels, "doc_id long, toxic int"))


def test_disturbed_insults_are_found_and_clean_texts_left(learnt):
    r = random.Random(6)

    def caught(change) -> float:
        return float((learnt.scores(pd.Series([write(r, [change(r.choice(INSULTS)) for _ in range(3)]) for _ in range(60)])) >= 0.3).mean())

    def insert(word: str) -> str:
        at = r.randrange(1, len(word))
        return word[:at] + r.choice("qzxkj") + word[at:]

    assert caught(str) == 1
    assert caught(str.upper) == 1
    assert caught("-".join) == 1
    assert caught(" ".join) > 0.9
    assert caught(insert) > 0.9
    clean = learnt.scores(pd.Series([write(r, []) for _ in range(200)]))
    assert (clean >= 0.3).mean() < 0.02


def test_odd_documents(odd, learnt):
    got = toxicity.score(odd.withColumn("score", F.lit(1)), learnt).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = learnt.scores(pd.Series([None, "", " \t", "12 345 !?"]))
    assert len(set(nothing.tolist())) == 1 and nothing[0] < 0.3


def test_an_insult_far_into_a_long_text_counts(learnt):
    r = random.Random(7)
    calm = " ".join(write(r, []) for _ in range(10_000))
    assert len(calm) > 2_000_000
    rude = calm + " " + " ".join(write(r, [w, w]) for w in INSULTS)
    most = learnt.statistics(pd.Series([calm, rude]))
    assert most[0, 2] == 0 < most[1, 2]


def test_labels_of_one_kind_or_none(lines, empty):
    docs = lines.createDataFrame([(i, f"some words {i}") for i in range(9)], "doc_id long, text string")
    marks = lambda rows: lines.createDataFrame(rows, "doc_id long, toxic int")
    assert toxicity.fit(docs, marks([(i, 1) for i in range(9)])).scores(pd.Series(["x"]))[0] > 0.9
    assert toxicity.fit(docs, marks([(i, 0) for i in range(9)])).scores(pd.Series(["x"]))[0] < 0.1
    assert toxicity.fit(docs, marks([])).scores(pd.Series(["x"]))[0] < 0.1
    assert toxicity.score(empty, toxicity.fit(empty, marks([(1, 1)]))).count() == 0


def test_query_scores_every_document(spark, sf_dir):
    from docloom.llm.registered import LLM_QUERIES

    rows = LLM_QUERIES["op12_toxicity"](spark, sf_dir).toPandas()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows["score"].between(0, 1).all()
    assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()
