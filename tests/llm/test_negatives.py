"""Hard negatives against brute force, with ties, repeats and odd vectors."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from docloom.llm import negatives
from docloom.llm.negatives import NEGATIVE, POSITIVE, Rule, mine_embeddings, pack, unpack, windows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, anchor, moved, rule: Rule) -> list[tuple]:
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(256 * x) for x in vector], (label + 1) % 10 if moved(vec_id) else label))
    out = []
    for i, (own_id, q, label) in enumerate(kept):
        if not anchor(own_id):
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), vec_id, other == label)
                  for j, (vec_id, v, other) in enumerate(kept) if j != i and len(v) == len(q)]
        scored.sort(key=lambda r: r[:2])
        for fall, positive_id, _ in [r for r in scored if r[2]][: rule.positives]:
            inside = [r for r in scored if not r[2] and -rule.floor * fall <= -100 * r[0] <= -100 * fall][: rule.negatives]
            out += [(own_id, positive_id, n, r[1], -fall, -r[0]) for n, r in enumerate(inside, 1)]
    return sorted(out)


def rows_of(seed: int, count: int = 400):
    import random

    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    # Coarse steps make many equal scores.
    rows = [(i, [round((c + r.gauss(0, 0.2)) * 8) / 8 for c in r.choice(centres)], r.randrange(4)) for i in range(count)]
    rows += rows[:30] + [(rows[7][0], rows[8][1], 9), (rows[20][0], [0.0] * 4, 1)]  # repeated rows and ids
    rows += [(900, None, 1), (901, [1.0, None, 0.0, 0.0], 1), (902, [1.0, float("nan"), 0.0, 0.0], 1),
             (903, [1.0, float("inf"), 0.0, 0.0], 1), (904, [1.0, 0.5, 0.0, 0.0], None), (None, [1.0, 0.5, 0.0, 0.0], 1),
             (905, [], 1), (910, [], 2), (920, [1.0, 1.0], 2), (930, [1.0, 0.9], 3), (940, [1.0, 0.9], 2)]
    return rows


@pytest.mark.parametrize("rule", [Rule(), Rule(positives=2, negatives=3, floor=95), Rule(negatives=40, floor=0)])
def test_equals_brute_force(lines, monkeypatch, rule):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 90)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 20)
    rows = rows_of(3)
    df = lines.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("uid", "score", "_block", "_group", "scores", "q", "anchor_id", "rank"):
        df = df.withColumn(name, F.lit("x"))
    got = mine_embeddings(df, F.col("vec_id") % 10 == 0, F.col("vec_id") % 7 == 0, rule)
    assert dict(got.dtypes)["rank"] == "int"
    wanted = brute_force(rows, lambda i: i % 10 == 0, lambda i: i % 7 == 0, rule)
    assert len(wanted) > 100
    assert sorted(map(tuple, got.collect())) == wanted


def test_one_label_holds_most_rows(lines, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 100)
    rows = [(i, v, 1 if i % 9 else 2) for i, v, _ in rows_of(4) if i is not None and i < 400]
    got = mine_embeddings(lines.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, F.lit(False))
    assert sorted(map(tuple, got.collect())) == brute_force(rows, lambda i: i % 10 == 0, lambda i: False, Rule())


def test_tables_without_answers(lines):
    none = lines.createDataFrame([], SCHEMA)
    assert mine_embeddings(none, F.lit(True), F.lit(False)).count() == 0
    lone = lines.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA)
    assert mine_embeddings(lone, F.lit(True), F.lit(False)).count() == 0
    assert mine_embeddings(lone, F.lit(False), F.lit(False)).count() == 0


def test_large_components_are_summed_as_integers(lines):
    # Doubles cannot hold these sums; the last two differ by one unit in 2^56.
    rows = [(0, [2.0**20, 1 / 256], 1), (1, [2.0**20, 2 / 256], 1), (2, [2.0**20, 1 / 256], 2), (3, [2.0**20, 3 / 256], 2)]
    got = mine_embeddings(lines.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, F.lit(False)).collect()
    big = (1 << 28) ** 2
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, big + 2, big + 1)]


def test_keys_sort_like_their_numbers():
    keys = [(a, s, k, i) for a in (0, 5, 1 << 40) for s in (-(1 << 50), -1, 0, 7, 1 << 50) for k in (POSITIVE, NEGATIVE) for i in (-3, 0, 9)]
    packed = sorted(pack(*k) for k in keys)
    assert [unpack(p) for p in packed] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))


def test_windows_are_read_as_a_stream():
    """The iterator hands out a negative before it asks for more keys than it needs."""
    asked = []

    def keys():
        for n, key in enumerate([pack(1, 100, POSITIVE, 7), pack(1, 90, NEGATIVE, 8), pack(1, 79, NEGATIVE, 9), pack(2, 50, NEGATIVE, 1)]):
            asked.append(n)
            yield key, 11

    stream = windows_of(keys(), Rule())
    assert next(stream) == (11, 7, 1, 8, 100, 90) and asked == [0, 1]
    assert list(stream) == []
