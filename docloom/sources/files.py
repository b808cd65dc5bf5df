"""Page texts as a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.urls import document_path


def document_files(documents: DataFrame, sequence: str) -> DataFrame:
    """``(file_path, content)``: the last page written under each name.

    The host is not part of a name, so pages of different sites can share one.
    Winners are found on names and numbers only; then each text moves once, by
    its unique ``sequence``.
    """
    winners = (
        documents.select(document_path(F.col("url")).alias("file_path"), sequence)
        .groupBy("file_path")
        .agg(F.max(sequence).alias(sequence))
    )
    return documents.select(sequence, "content").join(winners, sequence).select("file_path", "content")


def write_documents(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").parquet(path)
