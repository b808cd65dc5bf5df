"""Schemas of the knowledge-base tables and of the records that travel between jobs."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR_WIDTH = 1536
SOURCE_TYPES = ("official_package_documentation",)
SOURCE_TYPE = SOURCE_TYPES[0]


# Types by name; the first part of each table is required, the second may be NULL.
_TYPES = {
    "id": T.LongType(), "tool_id": T.LongType(), "page_id": T.LongType(),
    "chunk_number": T.IntegerType(), "embedding": T.ArrayType(T.FloatType()),
    "created_at": T.TimestampType(), "updated_at": T.TimestampType(),
}


def _table(columns: str, optional: str = "") -> T.StructType:
    return T.StructType(
        [
            T.StructField(name, _TYPES.get(name, T.StringType()), name in optional.split())
            for name in columns.split()
        ]
    )


TOOL_DOCS = _table("id tool_name source_type url created_at updated_at metadata")
PAGE = _table("id tool_id url created_at updated_at")
PAGE_CHUNK = _table(
    "id page_id chunk_number title summary content embedding metadata created_at updated_at",
    optional="embedding",
)
TABLES = {"tool_docs": TOOL_DOCS, "page": PAGE, "page_chunk": PAGE_CHUNK}
KEYS = {
    "tool_docs": ("tool_name", "source_type", "url"),
    "page": ("tool_id", "url"),
    "page_chunk": ("page_id", "chunk_number"),
}
# What a key match replaces, besides updated_at.
REPLACED = {
    "tool_docs": ("metadata",),
    "page": (),
    "page_chunk": ("title", "summary", "content", "embedding", "metadata"),
}

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
