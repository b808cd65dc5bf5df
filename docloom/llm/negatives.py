"""Hard negatives by a secondary sort: scores are packed into keys, and a stream of sorted keys is read once.

Anchors are scored against all rows in tiles, a block of rows by a group of
anchors. A first pass finds each anchor's positives. A second one packs what can
still be a negative into keys (anchor, descending score, kind, id);
``repartitionAndSortWithinPartitions`` brings an anchor's keys into one task in
the order of scores, where an iterator opens a window at each positive and hands
out negatives while they last. No task holds an anchor's rows: a tile keeps at
most ``positives`` rows, and ``negatives`` per window, of each of its anchors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

# Rows and anchors of a tile. A tile's scores are worked on SLAB anchors at a time.
BLOCK_ROWS = 32768
GROUP_ANCHORS = 16384
SLAB = 64
# Products of components are summed as doubles while all sums stay exact.
EXACT = 1 << 53
# A key: anchor, score, kind, id; big-endian, each moved so that bytes sort like numbers.
KEY = struct.Struct(">QQBQ")
TOP = 1 << 63
POSITIVE, NEGATIVE = 0, 1  # at one score the window is opened before it is filled

TRIPLES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Rule:
    """First ``positives`` rows of the anchor's label; for each, the first ``negatives`` of other labels whose
    score is at least ``floor`` hundredths of the positive's and not above it."""

    positives: int = 5
    negatives: int = 5
    floor: int = 80

    def inside(self, positive: np.ndarray | int, score: np.ndarray | int):
        return (self.floor * positive <= 100 * score) & (score <= positive)


def pack(anchor: int, score: int, kind: int, row_id: int) -> bytes:
    return KEY.pack(anchor + TOP, TOP - 1 - score, kind, row_id + TOP)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row_id = KEY.unpack(key)
    return anchor - TOP, TOP - 1 - score, kind, row_id - TOP


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component; null if the vector or a component is null, or one is not finite."""
    doubles = vector.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~F.exists(doubles, bad), F.transform(doubles, lambda x: F.floor(x * 256).cast("long")))


def prepare_rows(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, label, q): the rows that take part, numbered; stored, so the numbers stay."""
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), quantised(F.col("embedding")).alias("q"))
    whole = rows.where(F.col("label").isNotNull() & F.col("q").isNotNull() & F.col("vec_id").isNotNull())
    return cut_lineage(whole).withColumn("uid", F.monotonically_increasing_id())


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; by doubles where no sum can pass 2^53, which is exact."""
    most = max(np.abs(anchors).max(initial=0), np.abs(rows).max(initial=0))
    if float(most) ** 2 * max(1, rows.shape[1]) < EXACT:
        return np.rint(anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors @ rows.T


def mine(rows: DataFrame, anchors: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Hard negatives of ``anchors``, which are rows of ``rows`` (uid, vec_id, label, q), see ``prepare_rows``.

    Order of a row is its score, then its id. Rows that share an id are rows of
    their own: each may be an anchor, a positive and a negative, and only the
    anchor's own row is left out. Rows of other lengths than the anchor's are
    not compared with it. Scores are 64-bit numbers. A positive without a
    negative in its window gives no row; nor does an empty table.
    """
    spark = rows.sparkSession
    blocks, groups = rows.count() // BLOCK_ROWS + 1, anchors.count() // GROUP_ANCHORS + 1
    tiles = _Tiles(rows, blocks, groups)
    found = cut_lineage(_positives(tiles, anchors, rule))
    windows = found.groupBy(F.col("uid").alias("_uid")).agg(F.collect_list("score").alias("scores"))
    opened = anchors.join(windows, anchors["uid"] == F.col("_uid")).select("uid", "vec_id", "label", "q", "scores")
    kept = _negatives(tiles, opened, rule)

    def keyed(kind: int):
        return lambda r: (pack(r["uid"], r["score"], kind, r["vec_id"]), r["anchor_id"])

    pairs = found.rdd.map(keyed(POSITIVE)).union(kept.rdd.map(keyed(NEGATIVE)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = pairs.repartitionAndSortWithinPartitions(parts, _part)
    return spark.createDataFrame(ordered.mapPartitions(lambda part: windows_of(part, rule)), TRIPLES)


def _part(key: bytes) -> int:
    """Anchors are dealt by the number of their row, spread over all bits."""
    return (KEY.unpack(key)[0] * 0x9E3779B97F4A7C15 >> 17) & 0x7FFFFFFF


def windows_of(part: Iterator[tuple[bytes, int]], rule: Rule) -> Iterator[tuple]:
    """Triples of a sorted stream of keys: a positive opens a window, a negative fills those that hold its score."""
    current, opened = None, []
    for key, anchor_id in part:
        uid, score, kind, row_id = unpack(key)
        if uid != current:
            current, opened = uid, []
        if kind == POSITIVE:
            opened.append([row_id, score, 0])
            continue
        # Scores fall, so a window that a score leaves, or that is full, stays closed.
        opened = [w for w in opened if w[2] < rule.negatives and rule.inside(w[1], score)]
        for window in opened:
            window[2] += 1
            yield anchor_id, window[0], window[2], row_id, window[1], score


# --- tiles -----------------------------------------------------------------------------


@dataclass(frozen=True)
class _Tiles:
    """Rows dealt into blocks, each sent once to every group of anchors, and anchors once to every block."""

    rows: DataFrame
    blocks: int
    groups: int

    def meet(self, anchors: DataFrame, function, schema: str) -> DataFrame:
        block = F.pmod(F.xxhash64("uid"), F.lit(self.blocks)).cast("int")
        group = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(self.groups)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        # New names for the columns, since anchors are rows as well.
        own = anchors.withColumn("_group", group).select(*[F.col(c).alias(c) for c in (*anchors.columns, "_group")])
        left = own.select("*", every(self.blocks).alias("_block"))
        right = self.rows.withColumn("_block", block).select("*", every(self.groups).alias("_group"))
        keys = ("_block", "_group")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(function, schema)


def _tile(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Slabs of a tile: anchors, and for each the scores of all rows of its width, in the order of ids."""
    if anchors.empty or rows.empty:
        return
    rows = rows.sort_values("vec_id", kind="stable")
    wide, widths = rows["q"].map(len).to_numpy(), anchors["q"].map(len).to_numpy()
    for width in np.unique(widths):
        own = rows[wide == width]
        if own.empty:
            continue
        matrix = np.array(own["q"].tolist(), np.int64).reshape(len(own), width)
        asked = anchors[widths == width]
        vectors = np.array(asked["q"].tolist(), np.int64).reshape(len(asked), width)
        facts = [own[c].to_numpy() for c in ("uid", "vec_id", "label")]
        for at in range(0, len(asked), SLAB):
            yield asked.iloc[at : at + SLAB], scores(vectors[at : at + SLAB], matrix), *facts


def _first(score: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` of ``places``, which ascend by id, by falling score."""
    if len(places) > 4 * count:
        least = np.partition(score[places], len(places) - count)[len(places) - count]
        places = places[score[places] >= least]
    return places[np.argsort(-score[places], kind="stable")][:count]


def _positives(tiles: _Tiles, anchors: DataFrame, rule: Rule) -> DataFrame:
    """(uid, anchor_id, score, vec_id) of each anchor's positives."""

    def best(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for slab, table, uids, ids, labels in _tile(asked, rows):
            for i, (uid, anchor_id, label) in enumerate(zip(slab["uid"], slab["vec_id"], slab["label"], strict=True)):
                places = np.flatnonzero((labels == label) & (uids != uid))
                out += [(uid, anchor_id, table[i, p], ids[p]) for p in _first(table[i], places, rule.positives)]
        return pd.DataFrame(out, columns=["uid", "anchor_id", "score", "vec_id"])

    partial = tiles.meet(anchors, best, "uid long, anchor_id long, score long, vec_id long")
    # At most ``positives`` rows per anchor and block are left to merge.
    member = F.struct((-F.col("score")).alias("fall"), "vec_id")
    merged = partial.groupBy("uid", "anchor_id").agg(F.slice(F.sort_array(F.collect_list(member)), 1, rule.positives).alias("m"))
    each = merged.select("uid", "anchor_id", F.explode("m").alias("m"))
    return each.select("uid", "anchor_id", (-F.col("m.fall")).alias("score"), F.col("m.vec_id").alias("vec_id"))


def _negatives(tiles: _Tiles, opened: DataFrame, rule: Rule) -> DataFrame:
    """(uid, anchor_id, score, vec_id) of rows that are among the first of a window within their block."""

    def fitting(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for slab, table, _, ids, labels in _tile(asked, rows):
            facts = zip(slab["uid"], slab["vec_id"], slab["label"], slab["scores"], strict=True)
            for i, (uid, anchor_id, label, positives) in enumerate(facts):
                others = np.flatnonzero((labels != label) & (table[i] <= max(positives)))
                kept = set()
                for positive in set(positives):
                    kept.update(_first(table[i], others[rule.inside(positive, table[i][others])], rule.negatives).tolist())
                out += [(uid, anchor_id, table[i, p], ids[p]) for p in kept]
        return pd.DataFrame(out, columns=["uid", "anchor_id", "score", "vec_id"])

    return tiles.meet(opened, fitting, "uid long, anchor_id long, score long, vec_id long")


def mine_embeddings(vectors: DataFrame, anchor: Column, moved: Column, rule: Rule = Rule()) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, embedding, label) for which ``anchor`` is true.

    Rows with a null id or label, a null vector, or a component that is null or
    not finite take no part. Labels of rows with ``moved`` true are taken one
    further, modulo 10. More columns are not read.
    """
    label = F.when(moved, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = prepare_rows(vectors.select("vec_id", "embedding", label.alias("label")))
    return mine(rows, rows.where(anchor), rule)
