"""JSON expressions with strict types."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a failed title/summary call yields.
FALLBACK_TITLE = "Error processing title"
FALLBACK_SUMMARY = "Error processing summary"


def _string_field(document: Column, name: str) -> Column:
    """A string member of a JSON object; NULL where missing or of another type."""
    member = F.try_variant_get(document, f"$.{name}", "variant")
    return F.when(
        F.schema_of_variant(member) == "STRING", F.try_variant_get(document, f"$.{name}", "string")
    )


def reply_parse(reply: Column) -> Column:
    """``STRUCT<title, summary>`` of a model reply; both fallbacks unless both are strings."""
    document = F.try_parse_json(reply)
    title, summary = _string_field(document, "title"), _string_field(document, "summary")
    usable = title.isNotNull() & summary.isNotNull()
    return F.struct(
        F.when(usable, title).otherwise(FALLBACK_TITLE).alias("title"),
        F.when(usable, summary).otherwise(FALLBACK_SUMMARY).alias("summary"),
    )


def is_fallback(title: Column, summary: Column) -> Column:
    return (title == FALLBACK_TITLE) & (summary == FALLBACK_SUMMARY)


def contains_metadata(metadata: Column, wanted: dict) -> Column:
    """Whether a JSON object holds every wanted member, as JSON containment has it.

    Numbers are compared by value, objects member by member; an array holds
    another if it has each of its elements. An empty ``wanted`` matches every
    row. ``None`` matches an explicit JSON null only, not a missing member.
    """
    return F.lit(True) if not wanted else F.coalesce(_holds(F.try_parse_json(metadata), wanted), F.lit(False))


def _member_path(name: str) -> str:
    if "'" in name and '"' in name:
        raise ValueError(f"a member with both kinds of quotes cannot be named: {name}")
    return f"$[\"{name}\"]" if "'" in name else f"$['{name}']"


def _holder(wanted: object) -> Callable[[Column], Column]:
    return lambda value: F.coalesce(_holds(value, wanted), F.lit(False))


def _holds(value: Column, wanted: object) -> Column:
    """Whether a variant contains ``wanted``; NULL or false if it does not."""
    kind = F.schema_of_variant(value)
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, dict):
        found = F.startswith(kind, F.lit("OBJECT"))
        for name, part in wanted.items():
            member = F.try_variant_get(value, _member_path(name), "variant")
            found = found & F.coalesce(_holds(member, part), F.lit(False))
        return found
    if isinstance(wanted, list | tuple):
        found, items = F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>")
        for part in wanted:
            found = found & F.exists(items, _holder(part))
        return found
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    # Exact numbers are compared as text without needless zeros, which no scale rounds; others as doubles.
    text = F.try_variant_get(value, "$", "string")
    short = F.regexp_replace(F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text), "^-0$", "0")
    return (
        F.when(kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL)"), short == F.lit(_plain_number(wanted)))
        .when(kind.rlike("^(FLOAT|DOUBLE)"), F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))
        .otherwise(False)
    )


def _plain_number(wanted: int | float | Decimal) -> str:
    """A number in full, without exponent or needless zeros; "0" for either zero."""
    text = format(Decimal(str(wanted)), "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text
