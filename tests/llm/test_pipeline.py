"""Stages of the pipeline on odd documents: each stands nulls, repeats, clashing names and an empty table."""

from __future__ import annotations

import pytest

import corpus_pipeline
from docloom.llm import decontaminate
from tests.llm.conftest import SCHEMA, prose

# What each stage keeps of the odd documents, by id: copies go, texts without letters go.
KEPT = {
    "language": {1, 2, 3, 8, 9, 10, 11, None},
    "near_duplicates": {1, 2, 4, 7, 8, 9, 10, 11, None},
    "decontamination": {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None},
    "mixing": {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None},
}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_documents(lines, odd, empty, sf_dir, tmp_path, name, stage):
    odd.write.parquet(str(tmp_path / "docs"))
    docs = lines.read.parquet(str(tmp_path / "docs"))
    out = stage(lines, docs, sf_dir)
    rows = out.collect()
    if name == "quality":
        assert len(rows) <= docs.count()
    else:
        assert {r["doc_id"] for r in rows} == KEPT[name]
    if name != "mixing":
        assert out.columns == docs.columns
        assert stage(lines, empty, sf_dir).columns == empty.columns
    assert stage(lines, empty, sf_dir).count() == 0


def test_stages_are_in_order_and_run_gives_the_last(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "mixing"]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_planted_cases_go_and_clean_documents_stay(lines, sf_dir, tmp_path):
    items = lines.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(3).collect()
    clean = [(i, prose(1000 + i, 200), "en", "a") for i in range(20)]
    leaks = [(100 + i, f"{prose(2000 + i)} {item['text']} {prose(3000 + i)}", "en", "b") for i, item in enumerate(items)]
    copies = [(200 + i, clean[i][1], "en", "c") for i in range(5)]
    docs = lines.createDataFrame([*clean, *leaks, *copies], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    once = {r["doc_id"] for r in stages["near_duplicates"](lines, docs, sf_dir).collect()}
    assert once == {i for i, *_ in [*clean, *leaks]}
    kept = {r["doc_id"] for r in stages["decontamination"](lines, docs, sf_dir).collect()}
    assert kept == {i for i, *_ in [*clean, *copies]}
    found = decontaminate.matches(docs, lines.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(d[0], t["item_id"]) for d, t in zip(leaks, items, strict=True)}


def test_decontamination_judges_each_row_by_its_text(lines, sf_dir):
    item = lines.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    leak = f"{prose(5000)} {item} {prose(5001)}"
    docs = lines.createDataFrame(
        [(None, leak, "en", "a"), (None, prose(5002), "en", "a"), (1, leak, "en", "b"), (1, prose(5003), "en", "b"), (2, None, "en", "b")],
        SCHEMA,
    )
    kept = dict(corpus_pipeline.STAGES)["decontamination"](lines, docs, sf_dir).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(None, prose(5002)), (1, prose(5003)), (2, None)}
