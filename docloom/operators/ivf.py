"""Approximate search over inverted lists in cosine space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.vectors import RANK_DECIMALS
from docloom.operators.search import nearest, with_similarity
from docloom.operators.topk import Nearest, Shared, cosine_keys, scan_vectors, top_vectors
from docloom.session import cut_lineage

DEFAULT_LISTS = 100
DEFAULT_PROBES = 1
# Stands for all lists that every query of a block probes.
ALL = -1


@dataclass
class ListIndex:
    """``rows(id, embedding, list_id)`` and the centre of each list."""

    rows: DataFrame
    centres: np.ndarray


def indexable(items: DataFrame) -> DataFrame:
    """Vectors with a direction: NULL and zero vectors have no place in cosine space."""
    return items.where(F.exists("embedding", lambda x: x != 0))


def train(
    items: DataFrame, lists: int = DEFAULT_LISTS, seed: int = 0, sample: float = 1.0
) -> KMeansModel:
    """Cluster centres from all vectors, or a share of them where there are very many."""
    vectors = indexable(items).select(array_to_vector("embedding").alias("features"))
    if sample < 1.0:
        vectors = vectors.sample(sample, seed)
    return KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=10).fit(vectors)


def assign(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add ``list_id``: the nearest centre, the first of equals. Narrow; only the centres are shared."""

    @F.arrow_udf(T.IntegerType())
    def nearest_list(vectors: pa.Array) -> pa.Array:
        return pa.array(cosine_keys(centres, vectors, RANK_DECIMALS).argmin(axis=0).astype(np.int32))

    return indexable(items).withColumn("list_id", nearest_list("embedding"))


def build(
    items: DataFrame,
    lists: int = DEFAULT_LISTS,
    seed: int = 0,
    sample: float = 1.0,
    centres: np.ndarray | None = None,
) -> ListIndex:
    """The index of ``items``; centres are trained unless they are given.

    Rows are placed once, however many blocks of queries visit them.
    """
    if centres is None:
        centres = np.array(train(items.select("id", "embedding"), lists, seed, sample).clusterCenters())
    return ListIndex(cut_lineage(assign(items.select("id", "embedding"), centres)), centres)


def write_index(index: ListIndex, path: str) -> None:
    """Lists as partitions, so that a probe reads only its own; a long list gets several files."""
    (
        index.rows.repartitionByRange("list_id", "id")
        .write.mode("overwrite")
        .partitionBy("list_id")
        .parquet(f"{path}/rows")
    )
    spark = index.rows.sparkSession
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(index.centres)]
    spark.createDataFrame(centres, "list_id int, centre array<double>").write.mode(
        "overwrite"
    ).parquet(f"{path}/centres")


def read_index(spark: SparkSession, path: str) -> ListIndex:
    """The number of lists bounds what is brought to the driver: one centre each."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("list_id").collect()
    rows = spark.read.parquet(f"{path}/rows")
    return ListIndex(rows, np.array([row["centre"] for row in centres]))


def _probed(matrix: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """``[query, list]``: whether a list is among the nearest of a query."""
    lengths = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(centres, axis=1)[None, :]
    closeness = (matrix @ centres.T) / np.where(lengths == 0, 1.0, lengths)
    chosen = np.argsort(-closeness, axis=1, kind="stable")[:, :probes]
    out = np.zeros(closeness.shape, dtype=bool)
    np.put_along_axis(out, chosen, True, axis=1)
    return out


def search(index: ListIndex, queries: DataFrame, k: int, probes: int = DEFAULT_PROBES) -> DataFrame:
    """``(query_id, rank, id, similarity)`` from the nearest lists of each query.

    With as many probes as lists the result is the exact one over the vectors
    that have a place in the index. A zero or missing query vector is equally
    far from all: it gets the smallest ids of its lists.
    """

    def scan_block(block: tuple[np.ndarray, np.ndarray], share: Shared) -> DataFrame:
        ids, matrix = block
        probed = _probed(matrix, index.centres, probes)
        shared = share((matrix, probed))
        wanted = [int(i) for i in np.flatnonzero(probed.any(axis=0))]

        def visit(best: Nearest, batch: pa.RecordBatch) -> None:
            probed = shared.value[1]
            lists = batch.column("list_id").to_numpy()
            # Lists that all queries probe are one.
            lists = np.where(probed.all(axis=0)[lists], ALL, lists)
            for one in np.unique(lists):
                rows = None if one == ALL else np.flatnonzero(probed[:, one])
                if rows is None or len(rows):
                    part = batch.filter(pa.array(lists == one))
                    best.visit(rows, part.column("embedding"), part.column("id").to_numpy())

        rows = index.rows.where(F.col("list_id").isin(wanted)).select("id", "list_id", "embedding")
        return scan_vectors(rows, ids, k, lambda: shared.value[0], RANK_DECIMALS, visit)

    return with_similarity(top_vectors(queries, k, scan_block, index.rows.rdd.getNumPartitions()))


def recall(index: ListIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """``(query_id, found, recall)`` of the approximate search against the exact one."""
    exact = nearest(index.rows, queries, k).select("query_id", "id")
    close = search(index, queries, k, probes).select("query_id", "id", F.lit(1).alias("hit"))
    return (
        exact.join(close, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg(F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))
    )
