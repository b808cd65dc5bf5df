"""Approximate nearest neighbours: multi-index hashing of learned binary codes.

Codes are signs of vectors after learned rotations, cut into substrings of 16
bits. In a block of rows each substring has its index, from value to rows. By
the pigeonhole principle, codes within a radius of a query are close in one
substring at least: probing the substrings' values by growing distance finds
every code within the radius reached. Probing goes on until the radius holds
enough codes, which are then ranked by their original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import below_share, prepare
from docloom.operators.ranking import best_per_group
from docloom.session import cut_lineage

PIECE = 16  # bits of a substring
ROTATIONS = 4  # each gives a bit per component, up to MOST_BITS
MOST_BITS = 64
# The rotations are fitted on about this many vectors, chosen by a hash; all vectors are indexed.
SAMPLE = 8192
ROUNDS = 25
BLOCK_ROWS = 16384
QUERY_ROWS = 2048
# Of a block, at least this many codes, and this share of them, are ranked by their vectors.
LEAST, SHARE = 200, 0.03


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    rotations: list[np.ndarray]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Substrings of the code of each vector, a column each."""
        columns = []
        for rotation in self.rotations:
            bits = (x - self.mean) @ rotation > 0
            pad = -bits.shape[1] % PIECE
            packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).reshape(len(x), -1, PIECE // 8)
            columns.append(packed.astype(np.uint16) @ np.array([256, 1], np.uint16))
        return np.hstack(columns)


def learn(sample: np.ndarray, seed: int = 7) -> Codes:
    """Rotations by iterative quantization: principal axes, turned until signs are close to values."""
    random, mean = np.random.default_rng(seed), sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :MOST_BITS]
    values, rotations = centred @ axes, []
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(random.standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(values @ turn > 0, 1.0, -1.0).T @ values)
            turn = (left @ right).T
        rotations.append(axes @ turn)
    return Codes(mean, rotations)


@cache
def _masks(weight: int) -> np.ndarray:
    """All substrings with ``weight`` bits set."""
    every = np.arange(1 << PIECE, dtype=np.uint16)
    return every[np.bitwise_count(every) == weight]


class Index:
    """Substring indexes over the codes of one block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.rows = np.argsort(codes, axis=0, kind="stable")
        values = np.arange((1 << PIECE) + 1)
        self.starts = [
            np.searchsorted(codes[self.rows[:, j], j].astype(np.int64), values) for j in range(codes.shape[1])
        ]

    def within(self, code: np.ndarray, enough: int) -> np.ndarray:
        """Rows of all codes within the smallest radius that holds ``enough`` of them (or all there are).

        Probing substring j at distance d completes the radius ``d * pieces + j``.
        """
        count, pieces = self.codes.shape
        apart, found = np.full(count, -1, np.int64), np.zeros(PIECE * pieces + 1, np.int64)
        for distance in range(PIECE + 1):
            for j in range(pieces):
                probes = (_masks(distance) ^ code[j]).astype(np.int64)
                first, last = self.starts[j][probes], self.starts[j][probes + 1]
                sizes = last - first
                total = int(sizes.sum())
                if total:
                    places = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
                    rows = self.rows[places, j]
                    new = rows[apart[rows] < 0]
                    apart[new] = np.bitwise_count(self.codes[new] ^ code).sum(axis=1)
                    found += np.bincount(apart[new], minlength=len(found))
                radius = distance * pieces + j
                if found[: radius + 1].sum() >= min(enough, count):
                    return np.flatnonzero((apart >= 0) & (apart <= radius))
        return np.arange(count)


def sound(vectors: DataFrame) -> DataFrame:
    """Different (vec_id, embedding) rows that take part, as doubles.

    Left out are null ids, vectors that are null, empty, zero or hold null or
    non-finite components, and those of another length than the most common (ties: the
    longest).
    """
    values = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    nonzero = F.exists(values, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & nonzero)
    rows = cut_lineage(
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"), F.size("embedding").alias("_d"))
        .dropDuplicates(["vec_id", "embedding"])
    )
    usual = rows.groupBy("_d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("_d")).first()
    return rows.where(F.col("_d") == (usual["_d"] if usual else 0)).drop("_d")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id, embedding) for every row of ``queries``, likewise.

    Gives query_id, rank from 1, vec_id and score, the Euclidean distance in
    double precision; ties go to the smaller vec_id. Rows with the query's own
    id are no candidates. Rows that are equal in id and vector count once; ids
    that repeat with other vectors are rows, and queries, of their own. See
    :func:`sound` for what takes no part. Other columns are left out, whatever
    their names.

    Rows are dealt out to blocks of about ``BLOCK_ROWS`` and queries to groups
    of about ``QUERY_ROWS``; each pair of a block and a group is one step with
    an index of its own, so memory is bounded, and neither passes the driver.
    A step gives ``k`` rows per query, merged in two rounds.
    """
    spark = prepare(vectors.sparkSession)
    base = sound(vectors)
    hashed = F.xxhash64("vec_id", "embedding")
    count = base.count()
    asked = sound(queries)
    blocks, groups = count // BLOCK_ROWS + 1, asked.count() // QUERY_ROWS + 1
    found_schema = "query_id long, query long, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE / count)
    chosen = base.where(below_share(hashed, share))
    sample = np.array([r["embedding"] for r in chosen.select("embedding").toLocalIterator()])
    codes = spark.sparkContext.broadcast(learn(sample) if len(sample) else learn(np.eye(2)))

    def step(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(rows) and len(asks):
            x, q = np.stack(rows["embedding"].to_numpy()), np.stack(asks["embedding"].to_numpy())
            ids, index = rows["vec_id"].to_numpy(), Index(codes.value.of(x))
            enough = max(LEAST, int(SHARE * len(x)))
            for vector, code, own, name in zip(q, codes.value.of(q), asks["vec_id"], asks["query"], strict=True):
                near = index.within(code, enough + k)
                near = near[ids[near] != own]
                score = np.sqrt(((x[near] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], score))[:k]
                parts.append(
                    pd.DataFrame({"query_id": own, "query": name, "vec_id": ids[near[best]], "score": score[best]})
                )
        return pd.concat(parts) if parts else pd.DataFrame(columns=["query_id", "query", "vec_id", "score"])

    # Blocks and groups are known numbers of bounded groups; every pair of them is one.
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int")).withColumn("part", numbers(groups))
    right = asked.select(
        "vec_id", "embedding", hashed.alias("query"), F.pmod(hashed, F.lit(groups)).cast("int").alias("part")
    ).withColumn("block", numbers(blocks))
    steps = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(step, found_schema)
    best = best_per_group(
        steps, ["query_id", "query"], [F.col("score"), F.col("vec_id")], k, spread="vec_id", name="rank"
    )
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
