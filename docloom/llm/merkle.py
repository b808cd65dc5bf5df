"""Merkle manifest of a dataset: blocks of subtrees in van Emde Boas layout, proofs and their checks.

A forest holds one binary tree per group of rows, and one more over the groups'
roots. Leaves are cut into aligned blocks of 1024; a block is one stored row with
all digests of its subtree. The roots of the blocks are the leaves of the next
tier, until each tree is one block, so a table of a billion rows has three tiers.
Inside a block, nodes lie in van Emde Boas order: the upper half of the levels
first, then each lower subtree, both laid out by the same rule. ``address`` finds
a node from its place alone; building and sibling look-ups both go through it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ranking import number_rows
from docloom.session import cut_lineage, shared_dir

BLOCK_LEVELS = 10  # levels of a block above its leaves
BYTES = 32
# A step of a path is one byte for the side of the sibling, and its digest.
ALONE, LEFT, RIGHT = 0, 1, 2
STEP = 1 + BYTES

PATHS = "tree string, at long, subroot binary, path binary"


def digest_of(*parts: str) -> bytes:
    return hashlib.sha256("".join(parts).encode()).digest()


# --- layout ----------------------------------------------------------------------------


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of nodes ``index`` at ``depth`` of a full tree with ``levels`` levels of nodes."""
    at, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below, depth = levels - top, depth - top
        at += (1 << top) - 1 + (index >> depth) * ((1 << below) - 1)
        index = index & ((1 << depth) - 1)
        levels = below
    return at


def width(leaves: int, level: int) -> int:
    """Nodes that ``leaves`` leaves have ``level`` levels up: pairs become one, and so does a last one alone."""
    return -(-leaves >> level)  # rounded up


def subtree(digests: list[bytes], height: int) -> bytes:
    """All nodes of a block in layout order; places of nodes that it lacks hold zeros."""
    levels = height + 1
    nodes = np.zeros(((1 << levels) - 1, BYTES), np.uint8)
    row = digests
    for level in range(levels):
        if level:
            texts = [d.hex() for d in row]
            row = [digest_of(*texts[i : i + 2]) for i in range(0, len(texts), 2)]
        places = address(levels, height - level, np.arange(len(row)))
        nodes[places] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, BYTES)
    return nodes.tobytes()


def siblings(nodes: bytes, leaves: int, height: int, index: np.ndarray) -> list[bytes]:
    """The path of each leaf ``index`` to the root of its block: a step per level, from below."""
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, BYTES)
    steps = np.zeros((len(index), height, STEP), np.uint8)
    for level in range(height):
        other = (index >> level) ^ 1
        there = other < width(leaves, level)
        places = address(height + 1, height - level, np.where(there, other, 0))
        steps[:, level, 0] = np.where(there, np.where(other & 1, RIGHT, LEFT), ALONE)
        steps[:, level, 1:] = np.where(there[:, None], stored[places], 0)
    return [s.tobytes() for s in steps]


def fold(leaf: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and a path give, and the digest of the path's siblings."""
    reached, seen = leaf, []
    for at in range(0, len(path), STEP):
        side, other = path[at], path[at + 1 : at + STEP].hex()
        if side == ALONE:
            reached = digest_of(reached.hex())
            continue
        seen.append(other)
        reached = digest_of(other, reached.hex()) if side == LEFT else digest_of(reached.hex(), other)
    return reached, digest_of(*seen)


# --- building --------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Stored blocks by tier (tree, block, leaves, height, nodes), the trees' roots, and the root over them.

    ``paths`` (tree, at, subroot, path) leads from each tree's first-tier blocks to ``root``.
    """

    tiers: list[DataFrame]
    trees: DataFrame
    paths: DataFrame
    root: bytes | None
    levels: int


def build(leaves: DataFrame, folder: str | None = None, levels: int = BLOCK_LEVELS) -> Manifest:
    """Manifest of ``leaves`` (tree, at, digest): ``at`` runs from 0 in each tree, which have any names but null.

    Trees are ordered by name, bytewise. Blocks are written under ``folder``, a
    new one in the shared folder if none is named; one spans ``levels`` levels. No rows give no root.
    """
    folder = folder or f"{shared_dir(leaves.sparkSession).rstrip('/')}/merkle-{uuid.uuid4().hex}"
    tiers, roots = _climb(leaves, f"{folder}/trees", levels)
    trees = cut_lineage(number_rows(roots.select("tree", "digest"), "_number", ["tree"]))
    named = trees.select("tree", (F.col("_number") - 1).alias("at"), F.col("digest").alias("subroot"))
    top, over = _climb(named.select(F.lit("").alias("tree"), "at", F.col("subroot").alias("digest")), f"{folder}/forest", levels)
    found = over.select("digest").first()
    start = over.select("tree", F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), F.lit(b"").alias("path"))
    above = _descend(top, start, levels).select("at", "path")
    upper = named.join(above, "at").select("tree", F.lit(0).cast("long").alias("at"), "subroot", "path")
    root = None if found is None else bytes(found["digest"])
    return Manifest(tiers, named, _descend(tiers[1:], upper, levels), root, levels)


def _climb(level: DataFrame, folder: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all tiers over ``level`` (tree, at, digest), and the root of each tree (tree, at, digest)."""
    spark, tiers = level.sparkSession, []
    while True:
        at = f"{folder}/tier={len(tiers)}"
        _blocks(level, levels).write.parquet(at)
        tiers.append(spark.read.parquet(at))
        level = tiers[-1].select("tree", F.col("block").alias("at"), F.col("root").alias("digest"))
        if not level.where(F.col("at") > 0).limit(1).count():
            return tiers, level


def _blocks(level: DataFrame, levels: int) -> DataFrame:
    """One row per aligned block: at most 2^levels digests are ever brought together."""
    member = F.struct("at", "digest")
    gathered = level.groupBy("tree", F.shiftright("at", levels).alias("block")).agg(
        F.sort_array(F.collect_list(member)).alias("_rows")
    )
    # The last block of a tree of several climbs as high as the others; a lone one ends at one node.
    last = level.groupBy("tree").agg(F.max("at").alias("_last"))
    joined = gathered.join(last, "tree").select(
        "tree", "block", F.col("_rows.digest").alias("_digests"), (F.shiftright("_last", levels) > 0).alias("_several")
    )

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tree, block, digests, several in batch.itertuples(index=False):
                leaves = [bytes(d) for d in digests]
                height = levels if several else (len(leaves) - 1).bit_length()
                nodes = subtree(leaves, height)
                root = int(address(height + 1, 0, np.zeros(1))[0]) * BYTES
                rows.append((tree, block, len(leaves), height, nodes, nodes[root : root + BYTES]))
            yield pd.DataFrame(rows, columns=["tree", "block", "leaves", "height", "nodes", "root"])

    return joined.mapInPandas(built, "tree string, block long, leaves int, height int, nodes binary, root binary")


def _descend(tiers: list[DataFrame], paths: DataFrame, levels: int) -> DataFrame:
    """Paths of the leaves of ``tiers``' lowest, given those of the roots of its highest."""

    def lengthened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, block, leaves, height, nodes, subroot, path in batch.itertuples(index=False):
                own = siblings(nodes, leaves, height, np.arange(leaves))
                yield pd.DataFrame(
                    {
                        "tree": tree,
                        "at": (block << levels) + np.arange(leaves),
                        "subroot": [subroot] * leaves,
                        "path": [p + path for p in own],
                    }
                )

    for tier in reversed(tiers):
        blocks = tier.join(paths.withColumnRenamed("at", "block"), ["tree", "block"])
        paths = blocks.select("tree", "block", "leaves", "height", "nodes", "subroot", "path").mapInPandas(lengthened, PATHS)
    return paths


# --- proofs ----------------------------------------------------------------------------


def prove(manifest: Manifest, claims: DataFrame, claimed: str) -> DataFrame:
    """Add to ``claims`` (tree, at, digest ``claimed``, more) what the stored siblings make of each claim.

    ``subroot`` and ``proof_sha256`` are those of the stored tree, ``folded_root``
    is folded from the claimed digest and the stored siblings; all hex text.
    Claims meet their block, never each other's; a claim with a place that the
    manifest lacks gives no row.
    """
    levels, others = manifest.levels, [c for c in claims.columns if c not in ("tree", "at")]
    kept = F.struct("at", *others)
    grouped = claims.groupBy("tree", F.shiftright("at", levels).alias("block")).agg(F.collect_list(kept).alias("_rows"))
    blocks = manifest.tiers[0].join(manifest.paths.withColumnRenamed("at", "block"), ["tree", "block"])
    joined = blocks.join(grouped, ["tree", "block"]).select("_rows", "leaves", "height", "nodes", "subroot", "path")
    fields = {f.name: f.dataType.simpleString() for f in claims.schema.fields if f.name in others}
    schema = ", ".join([f"`{n}` {t}" for n, t in fields.items()] + ["subroot string, proof_sha256 string, folded_root string"])

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, leaves, height, nodes, subroot, path in batch.itertuples(index=False):
                places = np.array([r["at"] for r in rows], np.int64) & ((1 << levels) - 1)
                inside = places < leaves
                rows = [r for r, i in zip(rows, inside, strict=True) if i]
                folded = [
                    fold(bytes(r[claimed]), own + path)
                    for r, own in zip(rows, siblings(nodes, leaves, height, places[inside]), strict=True)
                ]
                out = {n: pd.Series([r[n] for r in rows], dtype=object) for n in others}
                out["subroot"] = [bytes(subroot).hex()] * len(rows)
                out["proof_sha256"] = [p.hex() for _, p in folded]
                out["folded_root"] = [r.hex() for r, _ in folded]
                yield pd.DataFrame(out)

    return joined.mapInPandas(checked, schema)


# --- documents -------------------------------------------------------------------------


def field(value: Column) -> Column:
    """A value of a leaf: its count of UTF-8 bytes, a colon, the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def tree_name(value: Column) -> Column:
    """Name of a group's tree; that of null comes before all others."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def verify_documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """Manifest of ``docs`` (doc_id, source, lang, n_chars, text) with a tree per lang, and the check of each row.

    Rows with ``tampered`` true are checked with ``n_chars`` one higher; a null
    there stays. Returns doc_id, leaf, subroot, root, proof_sha256 (all of the
    rows as they are), folded_root and verified.

    Nulls of any column are part of the leaf; null ids come first in their tree.
    Rows that share an id follow by their leaf's digest, so repeated rows are
    leaves of their own next to each other. Empty and very long texts are hashed
    whole by the JVM. No rows give no rows. More columns than those named are not
    read.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(columns)]
    hashed = docs.select(
        tree_name(F.col("lang")).alias("tree"),
        "doc_id",
        leaf_of(*columns).alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf_of(*changed)).alias("other"),
    )
    placed = number_rows(cut_lineage(hashed), "_number", ["doc_id", "leaf"], within=["tree"])
    rows = cut_lineage(placed.withColumn("at", F.col("_number") - 1).drop("_number"))
    manifest = build(rows.select("tree", "at", F.col("leaf").alias("digest")))
    claims = rows.select("tree", "at", "doc_id", "leaf", F.coalesce("other", "leaf").alias("claimed"))
    root = F.lit(None if manifest.root is None else manifest.root.hex()).cast("string")
    return prove(manifest, claims, "claimed").select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root",
        F.coalesce(F.col("folded_root") == root, F.lit(False)).alias("verified"),
    )
