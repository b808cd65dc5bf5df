"""SimHash near-duplicates: fingerprints, links within a Hamming radius, components.

Links are found with a Gray-order hierarchical index. Any two of 64 bits that
differ in ``RADIUS`` places agree in one of ``RADIUS + 1`` fields of bits, so
fingerprints are dealt out by each field. A part is sorted by Gray rank; in
that order neighbours differ in few bits, so runs of them share most bits. A
run becomes a node: the bits all its members share, as mask and pattern, and
16 nodes become one above. Differences add up on the way down, and a pair
of nodes whose shared bits already differ in more than ``RADIUS`` places is
dropped with all its members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.session import cut_lineage

BITS = 64
RADIUS = 2
SEED = 42
WORDS = 3
# Parts larger than this are dealt out again by fields of their other bits.
PART_ROWS = 1024
FANOUT = 16
# Shingles whose bits are counted at once.
BLOCK = 1 << 15

# --- fingerprints ------------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """Bits set in more than half of the XXH64 hashes of all 3-word shingles; 0 without words."""
    if not text:
        return 0
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist()
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        block = zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in block], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = counts * 2 > len(starts)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


# Only ASCII letters are lower-cased. bytes.split() cuts at exactly the white spaces of a word's
# definition: space and 0x09 to 0x0D.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a long of the same bits."""

    @F.pandas_udf("long")
    def of_texts(texts: pd.Series) -> pd.Series:
        prints = [fingerprint(t if isinstance(t, str) else None) for t in texts]
        return pd.Series(np.array(prints, np.uint64).view(np.int64))

    return of_texts(text)


def hex_column(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), BITS // 4, "0"))


# --- the index ---------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _nodes(pattern: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One node above each ``FANOUT`` nodes: mask of the bits that all share, and their pattern."""
    at = np.arange(0, len(pattern), FANOUT)
    alike = np.bitwise_and.reduceat(pattern, at) | ~np.bitwise_or.reduceat(pattern, at)
    mask = np.bitwise_and.reduceat(mask, at) & alike
    return pattern[at] & mask, mask


def links_of(codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``codes`` (different, sorted by Gray rank) at most ``radius`` bits apart.

    The index is joined with itself, level by level from the top. Only node
    pairs whose shared bits differ in at most ``radius`` places go down.
    """
    levels = [(codes, np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF)))]
    while len(levels[-1][0]) > FANOUT:
        levels.append(_nodes(*levels[-1]))
    count = len(levels[-1][0])
    a, b = np.triu_indices(count)
    for depth in range(len(levels) - 1, -1, -1):
        pattern, mask = levels[depth]
        apart = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
        near = apart <= radius
        a, b = a[near], b[near]
        if depth == 0:
            return a[a < b], b[a < b]
        below, step = len(levels[depth - 1][0]), np.arange(FANOUT)
        left = np.repeat(a * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(step, FANOUT), len(a))
        right = np.repeat(b * FANOUT, FANOUT * FANOUT) + np.tile(step, FANOUT * len(b))
        # Within one node, only one side of each pair.
        kept = (left < below) & (right < below) & (left <= right)
        a, b = left[kept], right[kept]
    raise AssertionError


def roots_of(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` places, the smallest place it is linked to through any pairs."""
    root = np.arange(count)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _fields(known: int, width: int) -> list[tuple[int, int]]:
    """Start and width of ``RADIUS + 1`` fields of the ``width`` bits from bit ``known`` on."""
    cuts = [known + width * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:], strict=False)]


def _dealt(parts: DataFrame, known: int) -> DataFrame:
    """Each fingerprint once for each field of its bits that are not yet known to agree.

    ``turned`` is the fingerprint rotated so that the known bits come first
    (lowest). ``part`` names the part: which fields were taken, and their bits.
    """
    options = []
    for i, (low, size) in enumerate(_fields(known, BITS - known)):
        # Move the field down to bit ``known``, and the bits below it above it.
        ones = F.lit((1 << size) - 1).cast("long")
        field = F.shiftrightunsigned("turned", low).bitwiseAND(ones)
        options.append(F.struct(F.lit(i).alias("which"), field.alias("bits"), F.lit(size).alias("size")))
    return (
        parts.withColumn("_field", F.explode(F.array(*options)))
        .withColumn("_low", F.element_at(F.array(*[F.lit(low) for low, _ in _fields(known, BITS - known)]), F.col("_field.which") + 1))
        .select(
            "print",
            _field_first(F.col("turned"), known, F.col("_low"), F.col("_field.size")).alias("turned"),
            F.xxhash64("part", "_field.which", "_field.bits").alias("part"),
        )
    )


def _field_first(turned: Column, known: int, low: Column, size: Column) -> Column:
    """Move bits ``low`` to ``low + size`` down to ``known``, after the known ones."""
    one = F.lit(1).cast("long")
    below = lambda n: F.call_function("shiftleft", one, n) - 1
    field = F.call_function("shiftrightunsigned", turned, low).bitwiseAND(below(size))
    skipped = F.call_function("shiftrightunsigned", turned, F.lit(known)).bitwiseAND(below(low - known))
    above = F.when(
        low + size < BITS,
        F.call_function(
            "shiftleft", F.call_function("shiftrightunsigned", turned, low + size), low + size
        ),
    ).otherwise(F.lit(0).cast("long"))
    kept = turned.bitwiseAND(F.lit((1 << known) - 1).cast("long"))
    placed = F.call_function("shiftleft", field, F.lit(known))
    moved = F.call_function("shiftleft", skipped, F.lit(known) + size)
    return kept.bitwiseOR(placed).bitwiseOR(moved).bitwiseOR(above)


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between the different fingerprints ``print``, at most ``RADIUS`` bits apart.

    Links that follow from others in the same part are left out: each part
    gives its members' links to the smallest place of their local component,
    so a part gives fewer links than it has members, however alike they are.
    Components of all links are those of all near pairs.
    """
    parts = prints.select("print", F.col("print").alias("turned"), F.lit(0).cast("long").alias("part"))
    known, found = 0, None
    while True:
        sizes = [size for _, size in _fields(known, BITS - known)]
        dealt = cut_lineage(_dealt(parts, known))
        counts = dealt.groupBy("part").agg(F.count("*").alias("_rows")).where(F.col("_rows") > 1)
        sized = cut_lineage(dealt.join(counts, "part"))
        known += min(sizes)
        # A part whose bits are known but for a few has few members: different prints are at most 2^bits.
        last = BITS - known <= (PART_ROWS - 1).bit_length()
        small = sized if last else sized.where(F.col("_rows") <= PART_ROWS)
        linked = small.repartition("part").sortWithinPartitions("part").mapInPandas(_part_links, "a long, b long")
        found = linked if found is None else found.unionByName(linked)
        if last:
            return found
        parts = sized.where(F.col("_rows") > PART_ROWS).drop("_rows")
        if parts.isEmpty():
            return found


def _part_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the parts in a task's rows, which are sorted by part; a part is at most ``PART_ROWS``."""
    held = pd.DataFrame({"print": [], "part": []}, dtype=np.int64)
    for batch in batches:
        rows = pd.concat([held, batch[["print", "part"]]])
        # The last part may go on in the next batch.
        open_ = rows["part"].to_numpy() == rows["part"].iloc[-1] if len(rows) else np.zeros(0, bool)
        held = rows[open_]
        yield _links_by_part(rows[~open_])
    yield _links_by_part(held)


def _links_by_part(rows: pd.DataFrame) -> pd.DataFrame:
    codes, part = rows["print"].to_numpy(np.int64).view(np.uint64), rows["part"].to_numpy(np.int64)
    order = np.lexsort((gray_rank(codes), part))
    codes, part = codes[order], part[order]
    starts = np.flatnonzero(np.diff(part, prepend=part[:1] - 1)) if len(part) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(part)))
    pairs_a, pairs_b = [], []
    # Small parts need no index: all are compared at once, members one apart, two apart and so on.
    small = np.repeat(sizes <= FANOUT, sizes)
    for apart in range(1, int(sizes[sizes <= FANOUT].max(initial=0))):
        a = np.flatnonzero(small[:-apart] & (part[:-apart] == part[apart:]))
        near = np.bitwise_count(codes[a] ^ codes[a + apart]) <= RADIUS
        pairs_a.append(a[near])
        pairs_b.append(a[near] + apart)
    for start, size in zip(starts[sizes > FANOUT], sizes[sizes > FANOUT], strict=True):
        a, b = links_of(codes[start : start + size])
        pairs_a.append(a + start)
        pairs_b.append(b + start)
    if not pairs_a:
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    root = roots_of(len(codes), np.concatenate(pairs_a), np.concatenate(pairs_b))
    signed, linked = codes.view(np.int64), np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": signed[linked], "b": signed[root[linked]]})


# --- the operator ------------------------------------------------------------------------


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, print, root (a fingerprint that names the component), component_id and a hash of each text."""
    printed = cut_lineage(
        docs.select(
            "doc_id", fingerprint_column(F.col("text")).alias("print"), F.xxhash64("text").alias("text_hash")
        )
    )
    # Copies shrink to one row here, in each task first.
    prints = cut_lineage(printed.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(prints)).withColumnRenamed("node", "print")
    classed = cut_lineage(
        prints.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    )
    names = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    return printed.join(classed.join(names, "root").select("print", "root", "component_id"), "print")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs`` (doc_id, text).

    Two documents are linked if their fingerprints differ in at most
    ``RADIUS`` bits; component_id is the smallest doc_id of all that links
    reach. Texts without words (null, empty, white space) have fingerprint 0
    and link like any other. Repeated rows are each given. A null doc_id is in
    its component but never names it, unless all are null. An empty table
    gives no rows; other columns are left out, whatever their names.
    """
    return _classes(docs).select("doc_id", hex_column(F.col("print")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, classed: Callable[[DataFrame], DataFrame] = _classes) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component, with all their columns.

    ``classed`` gives doc_id, text_hash and root of every row.

    The smallest doc_id stays; of several rows with it, the text with the
    smallest hash; of rows alike in both, any. Null ids come last, so one stays only of
    a component without others.
    """
    classes = cut_lineage(classed(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = classes.groupBy("root").agg(F.min(place).alias("b"), F.count("*").alias("n"))
    kept = best.select(F.col("b.doc_id").alias("_kept"), F.col("b.text_hash").alias("_hash")).distinct()
    # Rows alike in id and text are rare: only they are brought together whole.
    alike = classes.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1)

    def among(rows: DataFrame) -> Column:
        return rows["_kept"].eqNullSafe(docs["doc_id"]) & (rows["_hash"] == F.xxhash64(docs["text"]))

    if alike.isEmpty():
        return docs.join(kept, among(kept), "left_semi")
    marked = cut_lineage(
        kept.join(
            alike.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_other"), F.lit(True).alias("_twice")),
            F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_other") == F.col("_hash")),
            "left",
        )
    )
    once, twice = marked.where(F.col("_twice").isNull()), marked.where(F.col("_twice"))
    single = docs.join(once, among(once), "left_semi")
    return single.unionByName(docs.join(twice, among(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
