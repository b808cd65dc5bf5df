"""Keyed upserts of tools, pages and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ranking import last_wins, number_rows
from docloom.schema import KEYS, REPLACED, SOURCE_TYPES, TABLES, VECTOR_WIDTH
from docloom.session import cut_lineage


def changed_rows(
    table: str,
    existing: DataFrame,
    incoming: DataFrame,
    as_of: Column,
    top_id: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Rows of ``table`` after the upsert, for the keys of ``incoming`` only.

    ``incoming`` has the key, the replaced columns and ``seq``; of several rows
    with one key the last wins, unless the caller knows them to be ``unique``.
    A known key keeps its id and creation time, new keys get the ids after
    ``top_id`` (the greatest existing one) in key order. Ids are found on keys
    alone; of the existing rows only key, id and time are read, and an inner
    join lets the keys of a small batch go to them, so that they stay in place.
    What is replaced moves once: the last rows are found where they meet their ids.
    """
    keys = list(KEYS[table])
    latest = incoming.select(*keys, *REPLACED[table], "seq")
    latest = latest.drop("seq") if unique else last_wins(latest, keys, "seq").drop("seq")
    wanted = cut_lineage(latest.select(*keys))
    known = cut_lineage(existing.select(*keys, "id", "created_at").join(wanted, keys))
    if top_id is None:
        top_id = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    added = number_rows(wanted.join(known.select(*keys), keys, "left_anti"), "_number", keys)
    placed = known.unionByName(
        added.select(*keys, (F.col("_number") + top_id).alias("id"), F.lit(None).cast("timestamp").alias("created_at"))
    )
    rows = (
        latest.join(placed, keys)
        .withColumn("created_at", F.coalesce("created_at", as_of))
        .withColumn("updated_at", as_of)
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]])


def apply_changes(existing: DataFrame, changed: DataFrame) -> DataFrame:
    """The whole table: untouched rows as they are, changed ones in their new form."""
    kept = existing.join(changed.select("id"), "id", "left_anti")
    return kept.select(*changed.columns).unionByName(changed)


def upsert(table: str, existing: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    return apply_changes(existing, cut_lineage(changed_rows(table, existing, incoming, as_of)))


def prune_stale(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Drop chunks past the new length of their page; ``sizes(page_id, n_chunks)``.

    Not part of an upsert: by default a page that got shorter keeps its old tail.
    """
    return (
        chunks.join(sizes, "page_id", "left")
        .where(F.col("n_chunks").isNull() | (F.col("chunk_number") < F.col("n_chunks")))
        .drop("n_chunks")
    )


def flaws(incoming: DataFrame, width: int = VECTOR_WIDTH) -> DataFrame:
    """Add ``reason``: what is wrong with a chunk in itself, NULL if nothing is."""
    required = ("page_id", "chunk_number", "title", "summary", "content", "metadata")
    reason = F.coalesce(
        *[F.when(F.col(c).isNull(), f"null {c}") for c in required],
        F.when(F.size("embedding") != width, "vector size"),
        F.when(F.try_parse_json("metadata").isNull(), "bad metadata"),
    )
    return incoming.withColumn("reason", reason)


def reject_reasons(incoming: DataFrame, pages: DataFrame, width: int = VECTOR_WIDTH) -> DataFrame:
    """Add ``reason``: why a chunk cannot be stored, NULL if it can.

    One bad chunk does not hold up the others.
    """
    held = pages.select(F.col("id").alias("page_id"), F.lit(True).alias("_held"))
    judged = flaws(incoming, width).join(held, "page_id", "left")
    reason = F.coalesce("reason", F.when(F.col("_held").isNull(), "missing page"))
    return judged.withColumn("reason", reason).drop("_held")


def split_rejects(
    incoming: DataFrame, pages: DataFrame, width: int = VECTOR_WIDTH
) -> tuple[DataFrame, DataFrame]:
    """Chunks to store, and the rejected ones with their reason."""
    judged = cut_lineage(reject_reasons(incoming, pages, width))
    return (
        judged.where(F.col("reason").isNull()).drop("reason"),
        judged.where(F.col("reason").isNotNull()),
    )


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def constraint_report(
    tools: DataFrame, pages: DataFrame, chunks: DataFrame, width: int = VECTOR_WIDTH
) -> DataFrame:
    """``(table_name, constraint_name, violations)`` of every key, reference and domain."""
    tables = {"tool_docs": tools, "page": pages, "page_chunk": chunks}
    reports = []
    for name, df in tables.items():
        optional = {f.name for f in TABLES[name] if f.nullable}
        checks = {f"not null {c}": F.col(c).isNull() for c in df.columns if c not in optional}
        if name == "tool_docs":
            checks["source type"] = ~F.col("source_type").isin(*SOURCE_TYPES)
        if name == "page_chunk":
            checks["vector size"] = F.size("embedding") != width
        if "metadata" in df.columns:
            checks["json metadata"] = F.try_parse_json("metadata").isNull()
        totals = df.agg(*[_count(test).alias(check) for check, test in checks.items()])
        reports.append(
            totals.unpivot([], list(checks), "constraint_name", "violations").withColumn(
                "table_name", F.lit(name)
            )
        )
        for key in (("id",), KEYS[name]):
            repeated = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
            reports.append(_single(repeated, name, "unique " + ", ".join(key)))
    for child, column, parent in (("page", "tool_id", "tool_docs"), ("page_chunk", "page_id", "page")):
        known = tables[parent].select(F.col("id").alias(column))
        # Distinct references first: a parent with very many rows is looked up once.
        used = tables[child].groupBy(column).agg(F.count("*").alias("n"))
        orphans = used.where(F.col(column).isNotNull()).join(known, column, "left_anti")
        reports.append(
            orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
                F.lit(f"reference {column}").alias("constraint_name"),
                "violations",
                F.lit(child).alias("table_name"),
            )
        )
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out.select("table_name", "constraint_name", "violations")


def _single(violating: DataFrame, table: str, constraint: str) -> DataFrame:
    return violating.agg(F.count("*").alias("violations")).select(
        F.lit(constraint).alias("constraint_name"), "violations", F.lit(table).alias("table_name")
    )
