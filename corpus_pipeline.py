"""A training corpus in five stages, each an operator of ``docloom.llm`` that decides on all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language, mixing, near_copies, quality
from docloom.llm.common import prepare, table, word_count
from docloom.session import shared_dir

GOOD = 0.5  # least quality score
CLEAR = 0.5  # least share of a text's letters that one language has


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, accepts."""
    prepare(spark)
    model = quality.fit_labelled(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.text_column(F.col("text")) >= GOOD)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, at least half of them in one language."""
    prepare(spark)
    model = language.learn(docs)
    return docs.where(language.clear_column(docs, F.col("text"), model, CLEAR))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share at least 0.8 of their five-word shingles."""
    prepare(spark)
    return near_copies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. A row is judged by its own text, whatever its id."""
    prepare(spark)
    # Null ids count, and texts that share an id are told apart.
    key = F.xxhash64(docs["doc_id"], docs["text"])
    keyed = docs.select(key.alias("doc_id"), "text")
    held = decontaminate.matches(keyed, table(spark, sf_dir, "benchmark"))
    keys = held.select(F.col("doc_id").alias("held_key")).distinct()
    return docs.join(keys, keys["held_key"] == key, "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes of each document."""
    prepare(spark)
    text = F.col("text")
    return mixing.mix(
        docs.select("doc_id", "source", word_count(text).alias("size"), mixing.prose_weight(text).alias("weight"))
    )


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# Fingerprints, language paths and Gaussian densities have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written to the shared folder and read again by the next."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
