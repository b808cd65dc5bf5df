"""Top-k of many queries in one pass over the items.

A block of queries of bounded size travels to the tasks as one matrix. A task
scores its items batch by batch and keeps the k best per query, so it emits at
most k rows per query; the partial lists of many tasks are merged in two rounds.
No pair of query and item is ever a row. Cosines are screened in single
precision; those that may be among the k best are decided in double precision.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ranking import best_per_group
from docloom.session import cut_lineage, shared_dir

# Tasks get this module's code with their closures; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Queries that travel together: so many at most (vectors: so many times that), and about so many bytes.
BLOCK_QUERIES = 2048
VECTOR_BLOCKS = 16
BLOCK_BYTES = 24 << 20
SLICE_ROWS = 1024
# Items and queries of a tile of cosines, and items of the first one that bound a query's k best.
TILE_ITEMS = 2048
TILE_QUERIES = 512
BOUND_ITEMS = 256
# Numbers of the vectors that are taken in double precision at once.
EXACT_CELLS = 1 << 22
# Partial lists of so many tasks are merged at once.
MERGED_TASKS = 64

# Sort keys of distances that are not numbers: a cosine distance is at most 2.
NAN_KEY = 3.0
NULL_KEY = 4.0
NO_MATCH = np.inf

RESULT = ("query_id", "item_id", "rank_key", "rank")
RESULT_TYPES = "query_id long, item_id long, rank_key double, rank int"

Block = TypeVar("Block")
Scores = Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray]]


class Best:
    """The k smallest (key, id) pairs of every query."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.keys = np.full((queries, k), NO_MATCH)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray | None, keys: np.ndarray, ids: np.ndarray) -> None:
        """Merge ``keys[query, item]`` of the items ``ids`` into the given query rows."""
        rows = np.arange(len(self.keys)) if rows is None else rows
        hopeful = (keys <= self.keys[rows, -1:]).any(axis=1)
        rows, keys = rows[hopeful], keys[hopeful]
        if not len(rows):
            return
        keys = np.hstack([self.keys[rows], keys])
        ids = np.hstack([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
        kth = np.partition(keys, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        row, col = np.nonzero(keys <= kth)
        key, item = keys[row, col], ids[row, col]
        order = np.lexsort((item, key, row))
        row, key, item = row[order], key[order], item[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.keys[rows[row[kept]], place[kept]] = key[kept]
        self.ids[rows[row[kept]], place[kept]] = item[kept]

    def add_pairs(self, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        """Merge single items: the item ``ids[i]`` has ``keys[i]`` for the query row ``rows[i]``."""
        hopeful = keys <= self.keys[rows, -1]
        rows, keys, ids = rows[hopeful], keys[hopeful], ids[hopeful]
        if not len(rows):
            return
        met = np.unique(rows)
        row = np.concatenate([np.repeat(met, self.k), rows])
        key = np.concatenate([self.keys[met].ravel(), keys])
        item = np.concatenate([self.ids[met].ravel(), ids])
        order = np.lexsort((item, key, row))
        row, key, item = row[order], key[order], item[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.keys[row[kept], place[kept]] = key[kept]
        self.ids[row[kept], place[kept]] = item[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(self.keys != NO_MATCH)
        return query, self.ids[query, place], self.keys[query, place]


class Nearest(Best):
    """The k nearest items of every query, by the keys that ``cosine_keys`` gives.

    Cosines of unit vectors in single precision are off by a known bound; an
    item that they put further than that behind a query's k-th is none of its k best.
    All others get their key in double precision.
    """

    def __init__(self, queries: np.ndarray, k: int, decimals: int):
        super().__init__(len(queries), k)
        self.queries, self.decimals = queries, decimals
        self.lengths = np.linalg.norm(queries, axis=1)
        # Others are missing, without a direction or not finite.
        self.plain = np.isfinite(self.lengths) & (self.lengths > 0)
        self.units = _units(queries, np.where(self.plain, self.lengths, 1.0))
        # Twice the greatest error of a dot product of this many terms whose absolutes sum to at most 1.
        self.margin = (queries.shape[1] + 4) * 2.0**-23

    def visit(self, rows: np.ndarray | None, column: pa.Array, ids: np.ndarray) -> None:
        """Take in the items ``ids`` with the vectors ``column``, for the given query rows."""
        rows = np.arange(len(self.keys)) if rows is None else rows
        items, present = matrix_of(column)
        if len(items) and items.shape[1] != self.queries.shape[1] and not np.isnan(self.queries[rows]).any(axis=1).all():
            raise ValueError(f"different vector dimensions {items.shape[1]} and {self.queries.shape[1]}")
        lengths = np.linalg.norm(items, axis=1)
        held = np.flatnonzero(present)
        missing, zero = np.flatnonzero(~present), held[lengths == 0]
        # Items that are all as far from a query: the least ids are enough.
        missing, zero = self._least(ids, missing), self._least(ids, zero)
        plain, odd = rows[self.plain[rows]], rows[~self.plain[rows]]
        self._add_all(plain[self.keys[plain, -1] >= NAN_KEY], column, ids, np.concatenate([missing, zero]))
        finite = np.isfinite(lengths)
        alike = [missing, self._least(ids, held[finite]), self._least(ids, np.arange(len(ids)))]
        self._add_all(odd, column, ids, np.unique(np.concatenate(alike)))
        sound = finite & (lengths > 0)
        vectors, lengths, ids = items[sound], lengths[sound], ids[held[sound]]
        kept = self._few_copies(vectors, ids)
        self._screen(plain, vectors[kept], lengths[kept], ids[kept])

    def _least(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        if len(places) <= self.k:
            return places
        return places[np.argpartition(ids[places], self.k - 1)[: self.k]]

    def _add_all(self, rows: np.ndarray, column: pa.Array, ids: np.ndarray, places: np.ndarray) -> None:
        if len(rows) and len(places):
            self.add(rows, cosine_keys(self.queries[rows], column.take(pa.array(places)), self.decimals), ids[places])

    def _few_copies(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of the k least ids of each different vector: no other copy of it is among the k best."""
        if len(ids) <= self.k:
            return np.arange(len(ids))
        whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        copy = np.unique(whole, return_inverse=True)[1]
        order = np.lexsort((ids, copy))
        copy = copy[order]
        return order[np.arange(len(order)) - np.searchsorted(copy, copy) < self.k]

    def _screen(self, rows: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids):
            return
        units = _units(vectors, lengths).T
        step = max(1, EXACT_CELLS // vectors.shape[1])
        for start in range(0, len(rows), TILE_QUERIES):
            tile = rows[start : start + TILE_QUERIES]
            cosines = self.units[tile] @ units
            row, column = np.divmod(np.flatnonzero(cosines >= self._bounds(tile, cosines)[:, None]), len(ids))
            row = tile[row]
            for at in range(0, len(row), step):
                q, i = row[at : at + step], column[at : at + step]
                dot = np.einsum("ij,ij->i", self.queries[q], vectors[i])
                cosine = dot / (self.lengths[q] * lengths[i])
                self.add_pairs(q, np.round(1 - np.clip(cosine, -1, 1), self.decimals), ids[i])

    def _bounds(self, tile: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Per query the least cosine, in single precision, of an item that may be one of its k best."""
        kth = self.keys[tile, -1]
        found = kth < NAN_KEY
        bounds = np.where(found, 1 - kth - self.margin, -np.inf)
        first = cosines[~found, : max(BOUND_ITEMS, 4 * self.k)]
        if first.shape[1] > self.k and len(first):
            bounds[~found] = np.partition(first, -self.k, axis=1)[:, -self.k] - 2 * self.margin
        return bounds.astype(np.float32)


def _units(vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        return (vectors / lengths[:, None]).astype(np.float32)


class Shared:
    """Values sent to all tasks for one block of queries, and freed with it."""

    def __init__(self, spark: SparkSession):
        self._context, self._held = spark.sparkContext, []

    def __call__(self, value: object) -> Broadcast:
        self._held.append(self._context.broadcast(value))
        return self._held[-1]

    def free(self) -> None:
        for value in self._held:
            value.destroy()


def query_blocks(
    queries: DataFrame, size: Column, most: int, fetch: Callable[[DataFrame], Block]
) -> Iterator[Block]:
    """The query table in blocks of at most ``most``; ``size`` is what a query takes in a task, in bytes.

    The queries are evaluated once. One query larger than a block is a block.
    """
    held = cut_lineage(queries)
    totals = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    if totals["n"] <= most and totals["b"] <= BLOCK_BYTES:
        if totals["n"]:
            yield fetch(held)
        return
    # Hashed blocks differ in size: aim at half a block.
    blocks = max(-(-totals["n"] * 2 // most), int(-(-totals["b"] * 2 // BLOCK_BYTES)))
    # By the row, not by the id alone: rows that share an id do not fill one block.
    row = F.monotonically_increasing_id()
    placed = held.withColumn("_block", F.pmod(F.xxhash64("query_id", row), F.lit(blocks)).cast("int"))
    # A folder per block: each is read once, whatever their number.
    spark = queries.sparkSession
    path = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    placed.repartition("_block").write.partitionBy("_block").parquet(path)
    dealt = spark.read.schema(placed.schema).parquet(path)
    for block in [r["_block"] for r in placed.select("_block").distinct().orderBy("_block").collect()]:
        yield fetch(dealt.where(F.col("_block") == block).drop("_block"))


def vector_bytes(k: int) -> Column:
    """What a query takes: its vector as doubles, and its k best."""
    return F.lit(8) * F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(1)) + F.lit(16 * k)


def query_vectors(block: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block ``(query_id, vector)``; a missing vector is a row of NaN."""
    table = block.select("query_id", "vector").toArrow().combine_chunks()
    column = table.column("vector").combine_chunks()
    vectors, present = matrix_of(column)
    matrix = np.full((len(column), vectors.shape[1] if len(vectors) else 1), np.nan)
    matrix[present] = vectors
    return table.column("query_id").to_numpy().astype(np.int64), matrix


def scan(
    items: DataFrame, query_ids: np.ndarray, k: int, scorer: Callable[[pa.RecordBatch], Scores]
) -> DataFrame:
    """``(query_id, item_id, rank_key)``: each task's k best items of every query."""

    def visit(best: Best, batch: pa.RecordBatch) -> None:
        for rows, keys, ids in scorer(batch):
            best.add(rows, keys, ids)

    return _scan(items, query_ids, lambda: Best(len(query_ids), k), visit, SLICE_ROWS)


def scan_vectors(
    items: DataFrame,
    query_ids: np.ndarray,
    k: int,
    matrix: Callable[[], np.ndarray],
    decimals: int,
    visit: Callable[[Nearest, pa.RecordBatch], None],
) -> DataFrame:
    """The same for cosine distances to the vectors of ``matrix``, which a task asks for once."""
    return _scan(items, query_ids, lambda: Nearest(matrix(), k, decimals), visit, TILE_ITEMS)


def _scan(
    items: DataFrame,
    query_ids: np.ndarray,
    begin: Callable[[], Best],
    visit: Callable[[Best, pa.RecordBatch], None],
    slice_rows: int,
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = begin()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                visit(best, batch.slice(start, slice_rows))
        query, ids, keys = best.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[query]), pa.array(ids), pa.array(keys)],
            names=["query_id", "item_id", "rank_key"],
        )

    return items.mapInArrow(run, "query_id long, item_id long, rank_key double")


def top_k(
    queries: DataFrame,
    k: int,
    size: Column,
    scan_block: Callable[[Block, Shared], DataFrame],
    most: int | None = None,
    fetch: Callable[[DataFrame], Block] = DataFrame.collect,
    tasks: int | None = None,
) -> DataFrame:
    """``(query_id, rank, item_id, rank_key)`` over all blocks of queries.

    Each block's result is appended to one table in the shared folder, which is
    read once: the plan does not grow with the blocks, and what a block sent to
    the tasks is freed before the next. ``tasks`` that scan the items, if known
    to be few, are merged in one round.
    """
    spark = queries.sparkSession
    path = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    slices = {} if tasks is None or tasks > MERGED_TASKS else {"slices": 1}
    for block in query_blocks(queries, size, most or BLOCK_QUERIES, fetch):
        shared = Shared(spark)
        merged = best_per_group(
            scan_block(block, shared),
            ["query_id"],
            [F.col("rank_key"), F.col("item_id")],
            k,
            spread="item_id",
            name="rank",
            **slices,
        )
        merged.select(*RESULT).write.mode("append").parquet(path)
        shared.free()
    spark.createDataFrame([], RESULT_TYPES).write.mode("append").parquet(path)
    return spark.read.schema(RESULT_TYPES).parquet(path)


def top_vectors(
    queries: DataFrame,
    k: int,
    scan_block: Callable[[tuple[np.ndarray, np.ndarray], Shared], DataFrame],
    tasks: int | None = None,
) -> DataFrame:
    """``top_k`` of ``queries(query_id, vector)``, whose blocks are ids and a matrix."""
    most = BLOCK_QUERIES * VECTOR_BLOCKS
    return top_k(queries, k, vector_bytes(k), scan_block, most, query_vectors, tasks)


def matrix_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one batch as rows, and which of them are not NULL."""
    present = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)[present]
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("different vector dimensions in one column")
    return flat.reshape(len(lengths), -1) if len(lengths) else np.zeros((0, 0)), present


def cosine_keys(queries: np.ndarray, column: pa.Array, decimals: int) -> np.ndarray:
    """``[query, item]`` sort keys: the distance, or the key of NaN or NULL.

    A query of NaN stands for a missing one: its distances are NULL.
    """
    items, present = matrix_of(column)
    keys = np.full((len(queries), len(column)), NULL_KEY)
    known = ~np.isnan(queries).any(axis=1)
    if not len(items) or not known.any():
        return keys
    if items.shape[1] != queries.shape[1]:
        raise ValueError(f"different vector dimensions {items.shape[1]} and {queries.shape[1]}")
    lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(items, axis=1)[None, :]
    zero = lengths == 0
    cosine = (queries @ items.T) / np.where(zero, 1.0, lengths)
    distances = np.where(zero, NAN_KEY, np.round(1 - np.clip(cosine, -1, 1), decimals))
    keys[:, present] = np.where(known[:, None], distances, NULL_KEY)
    return keys
