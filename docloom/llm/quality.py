"""Quality scores: regularised quadratic discriminant over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import bloom
from docloom.llm.chars import DIGIT, LETTER, SPACE, UPPER, code_points, tables, tokens
from docloom.session import cut_lineage

# The statistics, after their transforms, in the order of the vectors.
STATISTICS = (
    "log characters", "log words", "log letter share", "log upper-case share", "log digit share",
    "log symbol share", "log symbols but stops", "log mean word length", "log distinct share",
    "log share of words like the one before", "log line breaks per word", "log capitalised share",
)
STOPS = np.array([ord(c) for c in ".,;:'’"], np.uint32)
NEWLINE = 10
# Shares are taken as if so many usual characters or words came before the text, so that one
# telephone number does not make a short text unlike all others.
PRIOR = 30
FLOOR = 0.01
RIDGE = 1e-3
# Log-density differences are divided by this before the logistic function, so that scores of
# clear documents do not all round to 0 or 1. It moves no score across one half.
TEMPERATURE = 8.0


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; null counts as empty."""
    codes = code_points(text or "")
    flags, words = tables().kind[codes], tokens(codes)
    count = len(words.hash)
    letters = (flags & LETTER) != 0
    symbol = (flags & (LETTER | DIGIT | SPACE)) == 0
    share = lambda hits, of, usual: (hits.sum() + PRIOR * usual) / (of + PRIOR)
    shares = (
        share(letters, len(codes), 0.8),
        share((flags & UPPER) != 0, letters.sum(), 0.03),
        share((flags & DIGIT) != 0, len(codes), 0.01),
        share(symbol, len(codes), 0.03),
        share(symbol & ~np.isin(codes, STOPS), len(codes), 0.01),
        share(words.end - words.start, 10 * count, 0.5),
        (len(np.unique(words.hash)) + PRIOR) / (count + PRIOR),
        share(words.hash[1:] == words.hash[:-1], count, 0.01),
        share(codes == NEWLINE, count, 0.05),
        share((flags[words.start] & UPPER) != 0, count, 0.15),
    )
    return np.concatenate([np.log1p([len(codes), len(words.hash)]), np.log(np.array(shares) + FLOOR)])


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of_texts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: statistics(t if isinstance(t, str) else None))

    return of_texts(text)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and offsets of the classes 0 and 1; ``constant`` if not both were seen."""

    constant: float
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.offsets):
            return np.full(len(x), self.constant)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = (x - mean) @ factor.T
            logs.append(offset - 0.5 * (z * z).sum(axis=1))
        odds = np.clip((logs[1] - logs[0]) / TEMPERATURE, -700, 700)
        return 1 / (1 + np.exp(-odds))

    def column(self, vector: Column) -> Column:
        @F.pandas_udf("double")
        def of_vectors(vectors: pd.Series) -> pd.Series:
            return pd.Series(self.scores(np.stack(vectors.to_numpy())) if len(vectors) else [], dtype=float)

        return of_vectors(vector)

    def text_column(self, text: Column) -> Column:
        """Score of a text in one step."""

        @F.pandas_udf("double")
        def of_texts(texts: pd.Series) -> pd.Series:
            rows = [statistics(t if isinstance(t, str) else None) for t in texts]
            return pd.Series(self.scores(np.stack(rows)) if rows else [], dtype=float)

        return of_texts(text)


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on all rows of ``labelled`` (quality 0 or 1, vector); other labels are left out.

    Each task sums the products of its rows' vectors, with a 1 put before them,
    and Spark adds these up: the driver gets two small matrices whatever the
    number of rows. A class covariance is shrunk towards the pooled one by
    ``d / (n + d)`` and gets a small ridge, so it can be factored even when a
    class has few rows. With no rows of a class, scores are the share of class
    1, or one half without any rows.
    """
    width = len(STATISTICS) + 1

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, width, width))
        for batch in batches:
            for label, part in batch.groupby("quality"):
                x = np.column_stack([np.ones(len(part)), np.stack(part["vector"].to_numpy())])
                sums[int(label)] += x.T @ x
        label, i, j = np.nonzero(sums)
        yield pd.DataFrame({"label": label, "i": i, "j": j, "value": sums[label, i, j]})

    rows = labelled.where(F.col("quality").isin(0, 1)).select(F.col("quality").cast("int"), "vector")
    added = rows.mapInPandas(products, "label int, i int, j int, value double")
    sums = np.zeros((2, width, width))
    for row in added.groupBy("label", "i", "j").agg(F.sum("value").alias("value")).collect():
        sums[row["label"], row["i"], row["j"]] = row["value"]
    counts = sums[:, 0, 0]
    if not counts.all():
        share = counts[1] / counts.sum() if counts.sum() else 0.5
        return Discriminant(float(share), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    means = sums[:, 0, 1:] / counts[:, None]
    scatter = np.array([s[1:, 1:] - n * np.outer(m, m) for s, n, m in zip(sums, counts, means, strict=True)])
    pooled = scatter.sum(axis=0) / counts.sum()
    factors, offsets = [], []
    for own, n in zip(scatter, counts, strict=True):
        shrink = (width - 1) / (n + width - 1)
        cov = (1 - shrink) * own / n + shrink * pooled + RIDGE * np.eye(width - 1)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n / counts.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(0.5, means, np.array(factors), np.array(offsets))


def fit_on(vectors: DataFrame, labels: DataFrame, learn: Column) -> Discriminant:
    """Fit on the rows of ``vectors`` (doc_id, vector) for which ``learn`` is true, with their labels.

    A document with several labels counts once for each; null ids have none.
    """
    return fit(vectors.where(learn).join(labels.select("doc_id", "quality"), "doc_id").select("quality", "vector"))


def fit_labelled(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all rows of ``docs`` (doc_id, text) that have a label; most others are not even measured."""
    ids = labels.select(F.col("doc_id").alias("_labelled")).distinct()
    flagged = bloom.build(ids, "_labelled").flag(docs.select("doc_id", "text"), F.col("doc_id"), "_maybe")
    maybe = flagged.where(F.col("_maybe"))
    return fit_on(cut_lineage(maybe.select("doc_id", statistics_column(F.col("text")).alias("vector"))), labels, F.lit(True))
