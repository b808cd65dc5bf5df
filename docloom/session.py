"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split across tasks even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Exchanged files go when the query that reads them ends: what a loop has moved does not pile up.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Vectors are 6 KB a row at 1536 dimensions: keep one Arrow batch near 12 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs rely on; cluster sizing is left alone."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    A machine-local folder is made up only for a local master, where one
    machine is the whole cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="docloom-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that loops keep short plans."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """Share a scan of few splits among all cores.

    Text expressions cost far more than moving the text once, and a file of one
    row group is one task. A scan that has a split per core is left as it is,
    so large inputs are never shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
