"""The registered queries: against SQL, or against brute force and held-out rows where SQL has no words for them."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from compare import connect, differences

import __spark_entry__ as entry_module
from docloom.llm.registered import LLM_QUERIES, LLM_SQL


@pytest.fixture(scope="module")
def read(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert differences(LLM_QUERIES[name](spark, sf_dir), connect(sf_dir), LLM_SQL[name]) is None


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in LLM_QUERIES}
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry_module.queries())


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_equals_brute_force(spark, sf_dir, read):
    rows = LLM_QUERIES["op1_simhash"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in read("documents").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: find(i) for i in ids}


def test_cross_entropy_prefers_good_texts(spark, sf_dir, read):
    scored = LLM_QUERIES["op3_cross_entropy"](spark, sf_dir)
    rows = scored.join(read("labels"), "doc_id").toPandas()
    assert scored.count() == read("documents").count()
    good, bad = rows[rows["quality"] == 1]["score"], rows[rows["quality"] == 0]["score"]
    assert good.max() < bad.median()
    assert np.allclose(rows["score"], rows["target_loss"] - rows["background_loss"])


def test_neighbours_find_nine_in_ten(spark, sf_dir, read):
    rows = LLM_QUERIES["op5_neighbours"](spark, sf_dir).toPandas()
    base = read("embeddings").toPandas()
    x, ids = np.array(base["embedding"].tolist(), float), base["vec_id"].to_numpy()
    hits = 0
    asked = np.flatnonzero(ids % 100 == 0)
    for i in asked:
        own = rows[rows["query_id"] == ids[i]].sort_values("rank")
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        place = {int(v): p for p, v in enumerate(ids)}
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own["score"], [far[place[v]] for v in own["vec_id"]])
        assert own["score"].is_monotonic_increasing
        far[i] = np.inf
        hits += len(set(own["vec_id"]) & set(ids[np.argsort(far)[:10]]))
    assert hits >= 0.9 * 10 * len(asked)


def test_decontamination_finds_whole_items_only(spark, sf_dir, read):
    found = {(r["doc_id"], r["item_id"]) for r in LLM_QUERIES["op6_decontamination"](spark, sf_dir).collect()}
    texts = read("documents").select("doc_id", "text").collect()
    items = read("benchmark").collect()
    assert found == {(d["doc_id"], i["item_id"]) for d in texts for i in items if i["text"] in d["text"]}


def test_language_of_held_out_documents(spark, sf_dir, read):
    rows = LLM_QUERIES["op7_language_id"](spark, sf_dir).join(read("documents"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(rows) == read("documents").count() and len(held)
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert rows["score"].between(0, 1).all()


def test_quality_of_held_out_documents(spark, sf_dir, read):
    scored = LLM_QUERIES["op10_quality"](spark, sf_dir)
    rows = scored.join(read("labels"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert scored.count() == read("documents").count()
    assert (held["quality"] == held["predicted"]).mean() > 0.9
    assert ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()


def test_licenses_are_the_planted_lines(spark, sf_dir, read):
    planted = {
        "Licensed under the Apache License, Version 2.0.": "apache",
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "All rights reserved.": "reserved",
    }
    wanted = set()
    for r in read("documents").select("doc_id", "text").collect():
        for number, line in enumerate(r["text"].split("\n"), 1):
            wanted |= {(r["doc_id"], number, family) for text, family in planted.items() if line.endswith(text)}
    found = {(r["doc_id"], r["paragraph"], r["family"]) for r in LLM_QUERIES["op9_licenses"](spark, sf_dir).collect()}
    assert wanted <= found
    assert all(family == "unknown" for _, _, family in found - wanted)


def test_pipeline_keeps_good_documents(spark, sf_dir, read):
    import corpus_pipeline

    docs, columns = read("documents"), read("documents").columns
    gone = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, out))
        gone[name] = before - after
        assert after <= before
        if name != "mixing":
            assert out.columns == columns
            docs = out
    labels = {r["doc_id"]: r["quality"] for r in read("labels").collect()}
    rejected = [labels[i] for i in gone["quality"] if i in labels]
    assert rejected.count(1) <= 0.02 * sum(labels.values())
    assert rejected.count(0) >= 0.9 * list(labels.values()).count(0)
    assert not gone["mixing"]
    texts = [r["text"] for r in docs.select("text").collect()]
    assert len(set(texts)) == len(texts)
    assert not any(item["text"] in text for item in read("benchmark").collect() for text in texts)
