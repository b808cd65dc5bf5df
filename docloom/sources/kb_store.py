"""The knowledge base on shared storage: three parquet tables and the memos.

A table is a set of segments by id range, each a list of parquet folders: a
base and the changes since. A commit writes its own rows only, as one more
folder for each segment that it touches, and then appends these folders to the
manifest; so it shows at once or not at all, what it costs follows the batch,
and a lost job is simply run again. Of rows with one id, readers take the
latest. ``compact`` merges changes into a new base, ``vacuum`` removes folders
that nothing refers to. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.enrichment import MEMO_PART, memo_part
from docloom.operators.search import KnowledgeBase
from docloom.operators.upsert import changed_rows
from docloom.schema import TABLES
from docloom.sources.storage import folders, remove_folder

# ``base``: the folder holds its whole segment, and those before it no longer count.
MANIFEST = "version LONG, table_name STRING, segment LONG, path STRING, top_id LONG, base BOOLEAN"
VERSION = "_version"
# A segment with this many changes is worth a new base.
CHANGES = 8
MEMOS = {
    "title": "memo_key STRING, title STRING, summary STRING",
    "vector": "memo_key STRING, embedding ARRAY<FLOAT>",
    "capture": "memo_key STRING, url STRING, final_url STRING, content STRING,"
    " links ARRAY<STRUCT<href: STRING, text: STRING>>",
}
# Column that places a row, and ids per segment. Chunks lie with their page.
SEGMENTS = {"tool_docs": ("id", 1_000_000), "page": ("id", 5_000_000), "page_chunk": ("page_id", 100_000)}


class KnowledgeStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._create_if_absent(f"{self.root}/manifest", MANIFEST)
        for name, schema in MEMOS.items():
            self._create_if_absent(f"{self.root}/memo/{name}", f"{schema}, {MEMO_PART} INT", MEMO_PART)

    def _create_if_absent(self, path: str, schema: str, *parts: str) -> None:
        try:
            self.spark.read.schema(schema).parquet(path)
        except AnalysisException:
            self.spark.createDataFrame([], schema).write.partitionBy(*parts).parquet(path)

    # --- tables

    def _manifest(self) -> list[Row]:
        """Live entries, the oldest first: one small row for each base and each change since."""
        entries = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        bases = entries.where("base").groupBy("table_name", "segment").agg(F.max("version").alias("since"))
        live = entries.join(bases, ["table_name", "segment"]).where(F.col("version") >= F.col("since"))
        return live.drop("since").orderBy("version").collect()

    def _entries(self, table: str) -> dict[int, list[Row]]:
        found: dict[int, list[Row]] = {}
        for row in self._manifest():
            if row["table_name"] == table:
                found.setdefault(row["segment"], []).append(row)
        return found

    def _scan(self, table: str, segments: list[list[Row]]) -> DataFrame:
        """The latest row of each id. Rows of a segment's last change are the latest; without changes nothing is moved."""
        schema = T.StructType([*TABLES[table].fields, T.StructField(VERSION, T.LongType())])
        if not segments:
            return self.spark.createDataFrame([], TABLES[table])

        def rows(entries: list[Row]) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*[row["path"] for row in entries])

        plain = [rows for rows in segments if len(rows) == 1]
        changed = [rows for rows in segments if len(rows) > 1]
        out = rows([row for entries in plain for row in entries]) if plain else None
        if changed:
            last = rows([entries[-1] for entries in changed])
            earlier = rows([row for entries in changed for row in entries[:-1]])
            later = rows([row for entries in changed for row in entries[1:]])
            newest = later.groupBy("id").agg(F.max(VERSION).alias("_newest"))
            kept = earlier.join(newest, "id", "left").where(
                F.col("_newest").isNull() | (F.col(VERSION) == F.col("_newest"))
            )
            kept = last.unionByName(kept.drop("_newest"))
            out = kept if out is None else out.unionByName(kept)
        return out.select(*TABLES[table].fieldNames())

    def read(self, table: str) -> DataFrame:
        return self._scan(table, list(self._entries(table).values()))

    def knowledge_base(self) -> KnowledgeBase:
        return KnowledgeBase(*[self.read(name) for name in ("tool_docs", "page", "page_chunk")])

    def _segment(self, table: str) -> Column:
        column, size = SEGMENTS[table]
        return F.floor(F.col(column) / size).alias("segment")

    def upsert(self, table: str, incoming: DataFrame, as_of: Column, unique: bool = False) -> DataFrame:
        """Merge ``incoming`` by key and return the rows that were written."""
        entries = self._entries(table)
        matching = list(entries.values())
        if table == "page_chunk" and entries:
            # A chunk's key holds its page, so only the pages' segments can match.
            found = incoming.select(self._segment(table)).distinct().collect()
            matching = [entries[row["segment"]] for row in found if row["segment"] in entries]
        top_id = max((row["top_id"] for rows in entries.values() for row in rows), default=0)
        existing = self._scan(table, matching)
        version, folder = self._write(table, changed_rows(table, existing, incoming, as_of, top_id, unique))
        changed = self.spark.read.schema(TABLES[table]).parquet(folder)
        touched = changed.groupBy(self._segment(table)).agg(F.max("id").alias("top_id")).collect()
        if touched:
            self._publish(table, version, folder, [(r["segment"], r["top_id"], r["segment"] not in entries) for r in touched])
        return changed

    def _write(self, table: str, rows: DataFrame) -> tuple[int, str]:
        """Write ``rows`` to a folder that no reader sees yet; its version and path."""
        version = 1 + max((row["version"] for row in self._manifest()), default=0)
        folder = f"{self.root}/{table}/v{version:09d}-{uuid.uuid4().hex[:8]}"
        # Ranges by id: a segment with very many rows gets several files, each with narrow bounds.
        (
            rows.withColumn("segment", self._segment(table))
            .withColumn(VERSION, F.lit(version).cast("long"))
            .repartitionByRange("segment", "id")
            .sortWithinPartitions("segment", "id")
            .write.partitionBy("segment")
            .parquet(folder)
        )
        return version, folder

    def _publish(self, table: str, version: int, folder: str, segments: list[tuple[int, int, bool]]) -> None:
        """Show a folder's ``segments`` (number, greatest id, whether it is its base) to readers."""
        entries = [(version, table, n, f"{folder}/segment={n}", top_id, base) for n, top_id, base in segments]
        new = self.spark.createDataFrame(entries, MANIFEST).coalesce(1)
        new.write.mode("append").parquet(f"{self.root}/manifest")

    def compact(self, table: str, least: int = CHANGES) -> int:
        """Give each segment with at least ``least`` changes a new base; how many it did."""
        due = {n: rows for n, rows in self._entries(table).items() if len(rows) > least}
        if due:
            segments = [(n, max(row["top_id"] for row in rows), True) for n, rows in due.items()]
            self._publish(table, *self._write(table, self._scan(table, list(due.values()))), segments)
        return len(due)

    def vacuum(self) -> int:
        """Remove table folders that no live entry refers to; how many it did. No one may be reading them."""
        live = {row["path"].rsplit("/", 2)[1] for row in self._manifest()}
        dead = [(name, f) for name in TABLES for f in folders(f"{self.root}/{name}") if f not in live]
        for name, folder in dead:
            remove_folder(f"{self.root}/{name}/{folder}")
        return len(dead)

    # --- memos

    def memo(self, name: str) -> DataFrame:
        """What is remembered, with the folder that each key lies in; see ``memo_hits``."""
        schema = f"{MEMOS[name]}, {MEMO_PART} INT"
        return self.spark.read.schema(schema).parquet(f"{self.root}/memo/{name}")

    def remember(self, name: str, additions: DataFrame) -> None:
        """Add rows: each folder that they fall in gets one more file, sorted by key."""
        placed = additions.withColumn(MEMO_PART, memo_part(F.col("memo_key")))
        ordered = placed.repartition(MEMO_PART).sortWithinPartitions(MEMO_PART, "memo_key")
        ordered.write.mode("append").partitionBy(MEMO_PART).parquet(f"{self.root}/memo/{name}")
