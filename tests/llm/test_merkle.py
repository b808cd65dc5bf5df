"""Merkle manifest: layout, blocks, proofs; odd documents against a plain tree."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle
from tests.llm.conftest import SCHEMA


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(row: list[str]) -> list[list[str]]:
    """All levels of a plain tree, leaves first."""
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_path(levels: list[list[str]], at: int) -> list[tuple[str, str] | None]:
    steps = []
    for row in levels[:-1]:
        other = at ^ 1
        steps.append(("left" if other < at else "right", row[other]) if other < len(row) else None)
        at >>= 1
    return steps


def plain_fold(leaf: str, steps) -> str:
    for step in steps:
        leaf = sha(leaf) if step is None else sha(step[1], leaf) if step[0] == "left" else sha(leaf, step[1])
    return leaf


def van_emde_boas(levels: int) -> list[tuple[int, int]]:
    """(depth, index) of all nodes in layout order, by the recursive definition."""
    if levels == 1:
        return [(0, 0)]
    top = levels // 2
    order = list(van_emde_boas(top))
    for tree in range(1 << top):
        order += [(top + d, (tree << d) + i) for d, i in van_emde_boas(levels - top)]
    return order


@pytest.mark.parametrize("levels", range(1, 12))
def test_addresses_are_the_recursive_order(levels):
    for place, (depth, index) in enumerate(van_emde_boas(levels)):
        assert merkle.address(levels, depth, np.array([index]))[0] == place


@pytest.mark.parametrize("leaves", [1, 2, 3, 5, 8, 13, 31, 32])
def test_blocks_prove_their_leaves(leaves):
    digests = [merkle.digest_of(str(i)) for i in range(leaves)]
    for height in ((leaves - 1).bit_length(), 6):
        nodes = merkle.subtree(digests, height)
        levels = levels_of([d.hex() for d in digests])
        root = levels[-1][0]
        for _ in range(height - len(levels) + 1):  # a lone block root climbs on
            root = sha(root)
        paths = merkle.siblings(nodes, leaves, height, np.arange(leaves))
        for digest, path in zip(digests, paths, strict=True):
            assert merkle.fold(digest, path)[0].hex() == root
            assert len(path) == height * merkle.STEP


def test_manifest_of_several_tiers_equals_plain_trees(lines):
    """Blocks of four leaves, trees of one to 150: several tiers, lone blocks and lone nodes."""
    sizes = {"": 1, "=a": 150, "=b": 17, "=c": 4, "=d": 64, "=e": 65, "=é": 3}
    rows = [(tree, at, merkle.digest_of(tree, str(at))) for tree, n in sizes.items() for at in range(n)]
    random.Random(1).shuffle(rows)
    leaves = lines.createDataFrame(rows, "tree string, at long, digest binary").repartition(7)
    manifest = merkle.build(leaves, levels=2)
    assert len(manifest.tiers) == 4
    trees = {t: levels_of([merkle.digest_of(t, str(at)).hex() for at in range(n)]) for t, n in sizes.items()}
    forest = levels_of([trees[t][-1][0] for t in sorted(trees, key=str.encode)])
    assert manifest.root.hex() == forest[-1][0]
    claims = leaves.withColumn("tree_", F.col("tree")).withColumn("at_", F.col("at"))
    wrong = claims.where("at = 2").withColumn("digest", F.lit(b"x" * 32))
    got = merkle.prove(manifest, claims.unionByName(wrong), "digest").collect()
    assert len(got) == len(rows) + sum(n > 2 for n in sizes.values())
    order = sorted(trees, key=str.encode)
    for r in got:
        steps = plain_path(trees[r["tree_"]], r["at_"]) + plain_path(forest, order.index(r["tree_"]))
        assert r["subroot"] == trees[r["tree_"]][-1][0]
        assert r["proof_sha256"] == sha(*[s[1] for s in steps if s])
        assert r["folded_root"] == plain_fold(bytes(r["digest"]).hex(), steps)
        assert (r["folded_root"] == forest[-1][0]) == (bytes(r["digest"]) != b"x" * 32)


def plain_leaf(*values) -> str:
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def test_odd_documents_equal_plain_trees(odd):
    docs = odd.withColumn("n_chars", F.length("text").cast("long")).withColumn("at", F.lit(1)).withColumn("tree", F.lit("x"))
    changed = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    got = merkle.verify_documents(docs, changed).collect()
    rows = [r.asDict() for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    for r in rows:
        facts = [r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
        r["leaf"] = plain_leaf(*facts)
        if r["n_chars"] is not None and (r["doc_id"] or 1) % 2 == 0:
            facts[3] += 1
        r["claimed"] = plain_leaf(*facts)
    names = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == n), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"])) for n in names]
    trees = [levels_of([r["leaf"] for r in g]) for g in groups]
    forest = levels_of([t[-1][0] for t in trees])
    wanted = []
    for number, group in enumerate(groups):
        for at, r in enumerate(group):
            steps = plain_path(trees[number], at) + plain_path(forest, number)
            folded = plain_fold(r["claimed"], steps)
            wanted.append((r["doc_id"], r["leaf"], trees[number][-1][0], forest[-1][0],
                           sha(*[s[1] for s in steps if s]), folded, folded == forest[-1][0]))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
    assert {r["verified"] for r in got} == {True, False}


def test_no_documents_and_one(lines, empty):
    columns = lambda df: df.withColumn("n_chars", F.lit(None).cast("long"))
    assert merkle.verify_documents(columns(empty), F.lit(True)).collect() == []
    one = columns(lines.createDataFrame([(None, None, None, None)], SCHEMA))
    (row,) = merkle.verify_documents(one, F.lit(True)).collect()
    leaf = sha("-----")
    assert tuple(row) == (None, leaf, leaf, leaf, sha(), leaf, True)
