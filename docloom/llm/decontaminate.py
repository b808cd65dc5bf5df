"""Benchmark decontamination: windows of templates are joined, their slots checked.

A text becomes a template: numbers, names and units turn into typed
placeholders, and what stood there is the slot's value. A question with other
numbers and names keeps its template, so windows of templates find it; a window
counts where its values are the item's own, or where equal slots of the item stay
equal in the document as they do in most of their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.chars import DIGIT, UPPER, code_points, mixed, tables, tokens, windows
from docloom.session import cut_lineage

WINDOW = 8
# Shorter items are one window of their own length; those under this many tokens are only looked for word by word.
SHORTEST = 4
# A window is a template if at least this share of it is literal; otherwise it is taken word by word.
LITERAL = 0.5
# A document holds an item if this many windows match in one line (a passage of 13 tokens), or
# this share of the windows of a shorter item.
RUN, SHARE = 6, 0.5
# Bits of the map that refuses windows of no item. Two bits a window; the map is 8 MB at most.
MAP_BITS = 26
WORD_BITS = 6

# Units as they follow a number, in lower case.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne"
    " tonnes lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds"
    " min minute minutes h hr hour hours day days week weeks month months year years percent degree degrees c f k"
    " dollar dollars cent cents euro euros usd eur gbp mph kmh kph w kw kwh v volt volts hz khz mhz ghz kb mb gb tb"
).split()
SENTENCE_ENDS = np.array([ord(c) for c in ".!?:;|\n\r\""], np.uint32)
NUMBER, NAME, UNIT = 1, 2, 3
PLACEHOLDER = mixed(np.array([0, 101, 102, 103], np.uint64))
VERBATIM = np.uint64(0x5BD1E995)  # tells word-by-word windows from templates


class Template(NamedTuple):
    kind: np.ndarray  # 0 literal, or the type of the placeholder
    value: np.ndarray  # hash of the token itself


def template(text: str | None) -> Template:
    """A number begins with a digit; a unit follows a number; a name is capitalised inside a sentence."""
    codes = code_points(text or "")
    words = tokens(codes)
    if not len(words.hash):
        return Template(np.zeros(0, np.int8), words.hash)
    flags = tables().kind[codes]
    first, second = flags[words.start], flags[np.minimum(words.start + 1, words.end - 1)]
    number = (first & DIGIT) != 0
    ends = np.concatenate([[0], np.cumsum(_ending()[codes], dtype=np.int32)])
    begins = np.ones(len(number), bool)
    begins[1:] = ends[words.start[1:]] > ends[words.end[:-1]]
    name = ((first & UPPER) != 0) & ((second & UPPER) == 0) & ~begins
    unit = np.zeros(len(number), bool)
    after = np.flatnonzero(number[:-1]) + 1
    unit[after] = np.isin(words.hash[after], _unit_hashes())
    return Template(np.select([number, unit, name], [NUMBER, UNIT, NAME], 0).astype(np.int8), words.hash)


@cache
def _ending() -> np.ndarray:
    """Whether each code point ends a sentence."""
    flags = np.zeros(len(tables().kind), bool)
    flags[SENTENCE_ENDS] = True
    return flags


@cache
def _unit_hashes() -> np.ndarray:
    return tokens(code_points(" ".join(UNITS))).hash


def window_hashes(t: Template, size: int) -> np.ndarray:
    """A hash of every window of ``size`` tokens: of the template, or of the words if it is mostly slots or short."""
    if size < SHORTEST:
        return windows(t.value, size) ^ VERBATIM
    shown = np.where(t.kind == 0, t.value, PLACEHOLDER[t.kind])
    whole = windows(shown, size)
    if not len(whole):
        return whole
    literal = np.concatenate([[0], np.cumsum(t.kind == 0)])
    enough = literal[size:] - literal[:-size] >= LITERAL * size
    if enough.all():
        return whole
    return np.where(enough, whole, windows(t.value, size) ^ VERBATIM)


_WINDOWS = "size int, at long, window long, slots array<struct<place:int,value:long>>"


def _rows(t: Template, size: int, at: np.ndarray, hashes: np.ndarray) -> Iterator[tuple]:
    signed, value = hashes.view(np.int64), t.value.view(np.int64)
    for i in at.tolist():
        slots = [{"place": int(k), "value": int(value[i + k])} for k in np.flatnonzero(t.kind[i : i + size])]
        yield size, i, int(signed[i]), slots


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of all items: item_id, item_windows (how many it has), size, at, window, slots."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                t = template(text)
                size = min(WINDOW, len(t.kind))
                if not size:
                    continue
                hashes = window_hashes(t, size)
                rows += [(item, len(hashes), *row) for row in _rows(t, size, np.arange(len(hashes)), hashes)]
            yield pd.DataFrame(rows, columns=["item_id", "item_windows", "size", "at", "window", "slots"])

    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    return items.mapInPandas(cut, f"item_id long, item_windows long, {_WINDOWS}")


def _map_places(window: Column) -> tuple[Column, Column]:
    mask = F.lit((1 << MAP_BITS) - 1).cast("long")
    return window.bitwiseAND(mask), F.shiftrightunsigned(window, 64 - MAP_BITS)


def window_map(item_rows: DataFrame) -> np.ndarray:
    """Bits of all windows of all items, as 64-bit words: of fixed size, whatever the benchmark's."""
    places = item_rows.select(F.explode(F.array(*_map_places(F.col("window")))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    words = places.groupBy(F.shiftright("p", WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(1 << (MAP_BITS - WORD_BITS), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _on_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for place in (hashes & np.uint64((1 << MAP_BITS) - 1), hashes >> np.uint64(64 - MAP_BITS)):
        hit &= (bits[place >> np.uint64(WORD_BITS)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, item_windows, same_slots of each item (item_id, text) that a document holds.

    ``matched`` counts the different windows of the item that the document
    (doc_id, text) has in one line: at one distance between the places in the
    two. Windows count whose values are the item's own, or those that the line
    has in most places of each value; a line in which two values or more, and
    over half of those that the item repeats there, do not stay equal counts not at all.
    ``same_slots`` says that all values are the item's own. A document may
    hold several items, each is given once, with its best line.

    Documents are scanned once and only windows that a small bit map lets
    through are moved, to an exact hash join. A null or empty text, and a null
    doc_id, match nothing; null items, and those without tokens, are left out. Items
    under four tokens are found as they stand, but for case and marks. Repeated rows of a document give the same result once. Other columns
    are left out, whatever their names.
    """
    spark = docs.sparkSession
    items = cut_lineage(item_windows(benchmark))
    bits = spark.sparkContext.broadcast(window_map(items))
    # At most WINDOW different numbers.
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                t = template(text)
                for size in sizes:
                    hashes = window_hashes(t, size)
                    at = np.flatnonzero(_on_map(bits.value, hashes))
                    rows += [(doc, *row) for row in _rows(t, size, at, hashes)]
            yield pd.DataFrame(rows, columns=["doc_id", "size", "at", "window", "slots"])

    read = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    hits = cut_lineage(read.mapInPandas(scan, f"doc_id long, {_WINDOWS}"))
    named = items.select(
        "item_id", "item_windows", "size", F.col("at").alias("item_at"), "window", F.col("slots").alias("item_slots")
    )
    line = ["doc_id", "item_id", "item_windows", "line"]
    joined = hits.join(named, ["window", "size"]).select(
        "doc_id", "item_id", "item_windows", (F.col("at") - F.col("item_at")).alias("line"), "item_at", "slots", "item_slots"
    )
    paired = cut_lineage(joined)
    counted = paired.groupBy(*line).agg(F.count_distinct("item_at").alias("matched"))
    # A row for each place of an item's value, with the document's value in that place. A window of
    # words has the item's own values, whatever is a slot in the document.
    ours = F.map_from_entries("slots")
    slots = paired.select(*line, "item_at", ours.alias("ours"), F.explode("item_slots").alias("s")).select(
        *line, "item_at", (F.col("item_at") + F.col("s.place")).alias("place"), F.col("s.value").alias("theirs"),
        F.coalesce(F.try_element_at("ours", F.col("s.place")), F.col("s.value")).alias("ours"),
    )
    met = (
        slots.groupBy(*line, "theirs", "ours").agg(F.count_distinct("place").alias("places"))
        .groupBy(*line, "theirs")
        .agg(
            F.count("*").alias("n"), F.sum("places").alias("places"),
            F.max((F.col("theirs") != F.col("ours")).cast("int")).alias("differ"),
            F.max(F.struct("places", (F.col("theirs") == F.col("ours")).alias("own"), "ours")).alias("usual"),
        )
    )
    met = cut_lineage(met.select(*line, "theirs", "n", "places", "differ", F.col("usual.ours").alias("usual")))
    changed = met.groupBy(*line).agg(
        F.max("differ").alias("differ"), F.count_if(F.col("n") > 1).alias("split"), F.count_if(F.col("places") > 1).alias("repeated")
    )
    # Only lines with a value that meets several are counted again, window by window.
    split = met.where(F.col("n") > 1).select(*line, "theirs", "usual")
    odd = slots.join(split, [*line, "theirs"]).where(F.col("ours") != F.col("usual")).select(*line, "item_at").distinct()
    moved = slots.where(F.col("ours") != F.col("theirs")).select(*line, "item_at").distinct()
    apart = odd.join(moved, [*line, "item_at"], "left_semi").groupBy(*line).agg(F.count("*").alias("apart"))
    agreed = (F.col("matched") - F.coalesce("apart", F.lit(0))).alias("matched")
    even = (F.coalesce("split", F.lit(0)) < 2) | (F.col("split") * 2 <= F.col("repeated"))
    best = (
        counted.join(changed, line, "left").join(apart, line, "left").where(even)
        .select(*line, agreed, "differ")
        .where(F.col("matched") >= F.least(F.lit(float(RUN)), SHARE * F.col("item_windows")))
        .groupBy("doc_id", "item_id", "item_windows")
        .agg(F.max(F.struct("matched", (F.coalesce("differ", F.lit(0)) == 0).alias("same"))).alias("best"))
    )
    return best.select(
        "doc_id", "item_id", F.col("best.matched").alias("matched"), "item_windows", F.col("best.same").alias("same_slots")
    )
