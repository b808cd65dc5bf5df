"""Package registry records as a table of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.urls import registry_url


def resolve_documentation(packages: DataFrame) -> DataFrame:
    """``(package, version, record)`` → with ``record_url``, ``documentation_url``, ``error``.

    The project link wins over the older single field; an empty string counts
    as missing. A package with neither gets an error that names it.
    """
    found = F.coalesce(
        *[
            F.nullif(F.get_json_object("record", path), F.lit(""))
            for path in ("$.info.project_urls.Documentation", "$.info.documentation_url")
        ]
    )
    # The paths in a record, and the text of the error.
    return packages.select(
        "package",
        registry_url(F.col("package"), F.col("version")).alias("record_url"),
        found.alias("documentation_url"),
    ).withColumn(
        "error",
        F.when(
            F.col("documentation_url").isNull(),
            F.concat(F.lit("No documentation URL found for "), "package"),
        ),
    )


def split_resolved(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages with a documentation URL, and the rejects."""
    return (
        resolved.where(F.col("error").isNull()).drop("error"),
        resolved.where(F.col("error").isNotNull()).select("package", "error"),
    )


# The names under which a crawl's settings are stored with its tool, in that order.
SETTING_NAMES = ("version", "depth", "strategy", "ignore_robots", "limit", "caching_enabled")


def crawl_settings() -> Column:
    """JSON of a row's crawl settings, as text members or nulls.

    Columns are named as the settings. A missing setting takes its usual value:
    breadth first, robots obeyed, captures remembered, no bounds; a bound of 0
    is stored as null, though the crawl keeps to it.
    """
    usual = {"strategy": "bfs", "ignore_robots": False, "caching_enabled": True}
    members = []
    for name in SETTING_NAMES:
        value = F.col(name) if name == "version" else F.nullif(F.col(name).cast("string"), F.lit("0"))
        members.append(F.coalesce(value, F.lit(usual[name]).cast("string")) if name in usual else value)
    named = [m.alias(n) for m, n in zip(members, SETTING_NAMES, strict=True)]
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})
