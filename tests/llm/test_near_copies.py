"""Near copies at 0.8 of five-word shingles, against brute force over all pairs."""

from __future__ import annotations

import random
from glob import glob

import numpy as np
import pytest

from docloom.llm import components, near_copies, simhash
from tests.llm.conftest import ODD, SCHEMA

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def changed(text: str, edits: int, random_: random.Random) -> str:
    words = text.split()
    for at in random_.sample(range(len(words)), min(edits, len(words))):
        words[at] = "".join(random_.choices(LETTERS, k=6))
    return " ".join(words)


def passage(words: int, random_: random.Random) -> str:
    return " ".join("".join(random_.choices(LETTERS, k=random_.randint(2, 5))) for _ in range(words))


def corpus(seed: int) -> list[str]:
    """Texts of 3 to 900 words in families with more and more edits; every third holds one of two shared passages."""
    random_ = random.Random(seed)
    shared = [passage(60, random_) for _ in range(2)]
    texts = []
    for family in range(60):
        base = passage(random_.choice((3, 6, 9, 12, 20, 40, 80, 150, 300, 900)), random_)
        if family % 3 == 0:
            base = f"{base} {random_.choice(shared)}"
        texts.append(base)
        most = max(len(base.split()) // 30, 1)
        texts += [changed(random_.choice(texts[-3:]), random_.randint(1, most), random_) for _ in range(8)]
    return texts


def shingle_set(text: str | None) -> frozenset[str]:
    words = (text or "").lower().split()
    if len(words) < 5:
        return frozenset([" ".join(words)]) if words else frozenset()
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def by_brute_force(texts: list[str | None]) -> tuple[list[int], int]:
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if similarity(sets[i], sets[j]) >= 0.8]
    a, b = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
    return simhash.roots_of(len(sets), a, b).tolist(), len(pairs)


def groups(rows: list, key: str) -> set[frozenset]:
    found: dict = {}
    for r in rows:
        found.setdefault(r[key], set()).add(r["doc_id"])
    return {frozenset(g) for g in found.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_those_of_all_similar_pairs(lines, seed):
    texts = corpus(seed)
    roots, pairs = by_brute_force(texts)
    assert pairs > 200 and len(set(roots)) > 60
    docs = lines.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = groups(near_copies.classes(docs).collect(), "root")
    assert got == groups([{"doc_id": i, "root": r} for i, r in enumerate(roots)], "root")


def test_similar_sets_share_a_run():
    """Shared hashes outnumber the others four to one, so four of them are in line."""
    random_ = np.random.default_rng(3)
    for _ in range(2000):
        shared = int(random_.integers(4, 24))
        others = int(random_.integers(0, shared // 4 + 1))
        every = np.unique(random_.integers(0, 2**63, shared + others).astype(np.uint64))
        random_.shuffle(every)
        cut = shared + int(random_.integers(0, others + 1))
        a, b = np.sort(every[:cut]), np.sort(np.concatenate([every[:shared], every[cut:]]))
        assert np.intersect1d(near_copies.runs(a), near_copies.runs(b)).size


def test_near_copies_of_all_documents(lines, sf_dir):
    """Whole table: the classes that brute force finds among the texts that share any shingle."""
    docs = lines.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    sets = {i: shingle_set(texts[i]) for i in ids}
    holders: dict = {}
    pairs = set()
    for i in ids:
        seen: dict = {}
        for shingle in sets[i]:
            for j in holders.setdefault(shingle, []):
                seen[j] = seen.get(j, 0) + 1
            holders[shingle].append(i)
        pairs |= {(j, i) for j, n in seen.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9}
    place = {i: at for at, i in enumerate(ids)}
    a, b = (np.array([place[p[side]] for p in pairs], int) for side in (0, 1))
    roots = simhash.roots_of(len(ids), a, b)
    blank = [place[i] for i in ids if not sets[i]]
    roots[blank] = min(blank, default=0)
    want = groups([{"doc_id": i, "root": roots[place[i]]} for i in ids], "root")
    assert groups(near_copies.classes(docs).collect(), "root") == want


def test_rounds_leave_no_exchanged_files(lines):
    """Files of an exchange go when the query that reads them ends, so that rounds do not pile them up."""
    root = lines.sparkContext.getConf().get("spark.local.dir", "/tmp")
    texts = corpus(3)[:120]
    docs = lines.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], SCHEMA)
    before = set(glob(f"{root}/blockmgr-*/*/shuffle_*"))
    near_copies.classes(docs).count()
    assert not set(glob(f"{root}/blockmgr-*/*/shuffle_*")) - before


def test_stars_of_links_take_one_step(lines, monkeypatch):
    """No further step is made to see that nothing changes."""
    cuts = []
    monkeypatch.setattr(components, "cut_lineage", lambda df: cuts.append(1) or near_copies.cut_lineage(df))
    links = [(1, i) for i in range(2, 50)] + [(60, 61), (5, 1)]
    got = {r["node"]: r["root"] for r in components.components(lines.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 50)} | {60: 60, 61: 60} and len(cuts) == 2


def test_places_meet_their_leader_without_a_join(lines):
    """Hot groups are in parts that each hold the leader; groups without one are left out."""
    hot = 3 * near_copies.TOGETHER
    rows = [(1, i, hot) for i in range(hot)] + [(2, 7, 2), (2, 8, 2), (3, 9, 2)]
    places = lines.createDataFrame(rows, "run long, id long, n long")
    leaders = lines.createDataFrame([(1, hot, 5, 50), (2, 2, 8, 8)], "run long, n long, b long, root_b long")
    met = near_copies._with_leaders(places, leaders)
    assert "Join" not in met._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in met.select("run", "id", "n", "b", "root_b").collect())
    assert got == [(1, i, hot, 5, 50) for i in range(hot)] + [(2, 7, 2, 8, 8), (2, 8, 2, 8, 8)]


def test_odd_documents(odd, empty):
    rows = near_copies.classes(odd).collect()
    assert len(rows) == len(ODD)
    blank = {r["root"] for r in rows if r["doc_id"] in (4, 5, 6)}
    assert len(blank) == 1
    assert near_copies.classes(empty).count() == 0
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and near_copies.keep_one(empty).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 7, 8, 9, 10, 11] and ids.count(None) == 1
