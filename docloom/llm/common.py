"""What the operators share: session settings, tables, splits by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import shared_dir, tune

# A word is a run of anything but these white spaces.
WORD = r"[^\x20\x09-\x0D]+"

# Hashes are taken modulo this where a share of them is chosen.
SPAN = 1 << 52

SETTINGS = {
    # Arrow batches of whole texts: bounded in rows and, for very long texts, in bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; the checkpoint folder is the session's own if it has one."""
    tune(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def below_share(hash_: Column, share: float) -> Column:
    """Whether a 64-bit hash falls in the first ``share`` of its range: a sample that reruns repeat."""
    return F.pmod(hash_, F.lit(SPAN)) < F.lit(int(share * SPAN))
