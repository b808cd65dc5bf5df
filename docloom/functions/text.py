"""Text helpers with the string semantics of the documents' producer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space when text is stripped.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

FENCE = "```"
TO_END = 2**31 - 1


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle``, counted from the left."""
    gone = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.length(text) - gone) / len(needle)).cast("int")


def last_index(text: Column, needle: str) -> Column:
    """0-based position of the last ``needle``, or -1."""
    tail = F.substring_index(text, needle, -1)
    return F.when(
        F.contains(text, F.lit(needle)), F.length(text) - F.length(tail) - len(needle)
    ).otherwise(-1)


def prompt_excerpt(url: Column, content: Column) -> Column:
    """The request text of one title/summary call: the first 1000 characters.

    Fixed values: its wording and that number.
    """
    return F.concat(
        F.lit("URL: "), url, F.lit("\n\nContent:\n"), F.substring(content, 1, 1000), F.lit("...")
    )


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def squash(text: Column) -> Column:
    """White-space runs become one space."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def unfence(reply: Column) -> Column:
    """Payload of a reply that may be wrapped in a fenced block.

    The language tag goes with the first line; everything from the last fence
    on is dropped.
    """
    opened = F.substring(reply, F.locate(FENCE, reply) + len(FENCE), F.lit(TO_END))
    body = F.regexp_replace(opened, r"^[^\n]*\n", "")
    return strip(
        F.when(F.contains(reply, F.lit(FENCE)), F.regexp_replace(body, r"(?s)^(.*)```.*$", "$1"))
        .otherwise(reply)
    )
