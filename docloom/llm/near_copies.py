"""Near copies at a Jaccard similarity of word shingles, by SimHash prints, their index, and runs of shingles.

SimHash prints of texts that share 0.8 of their shingles lie about ten bits
apart, further than the Gray-order index can prune. So its links (prints at
most ``simhash.RADIUS`` bits apart) are one source of candidates, and runs are
the other: the different shingles of a text are sorted by hash, as a ring, and
neighbours of that ring make a run. If two texts share at least 0.8 of their
shingles, the shared ones outnumber the others four to one, so between two
of the others somewhere lie four shared ones in line, in both rings. Texts of
fewer than ``SMALL`` shingles keep all runs of four, so similar ones always have
one in common. From there on texts are in tiers of four times the size each;
a tier's runs are three longer and start at half as many of the hashes, by
which similar texts have 7 to 30 in common on average, and unlike ones, that
share a passage or a third of their shingles, hardly any.

Candidates whose prints or sizes are too far apart go first; what remains is
decided on the whole sets of shingles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.components import components
from docloom.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
RUN = 4
SMALL = 32
# Bits between the prints of a candidate. At a similarity of 0.8 prints differ in 9.7 of 64 on average;
# 18 is 2.9 standard deviations above.
FAR = 18
# Links of one text that are checked against one copy of its shingles.
LINKS = 512
# Places of a group that are brought together with its leader.
TOGETHER = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different 5-word shingles; of the whole sequence, if it has fewer words."""
    words = text.encode().translate(simhash._LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return np.array([digest(joined, simhash.SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], simhash.SEED) for a, b in zip(starts, ends, strict=True)], np.uint64))


def print_of(hashes: np.ndarray) -> int:
    """SimHash of a set of hashes: bits set in more than half of them."""
    counts = np.zeros(simhash.BITS, np.int64)
    for i in range(0, len(hashes), simhash.BLOCK):
        block = hashes[i : i + simhash.BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _tier(size: float) -> int:
    """0 below ``SMALL`` shingles, then one more at each four times the size."""
    tier = 0
    while size >= SMALL * 4**tier:
        tier += 1
    return tier


def runs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs in the ring of sorted hashes; none below ``RUN``, where only equal sets are alike.

    A text near the lower end of its tier has the runs of the tier below as
    well, as texts alike to it may be there.
    """
    if len(hashes) < RUN:
        return np.zeros(0, np.uint64)
    spread = hashes * MIX
    spread ^= spread >> np.uint64(29)
    found = []
    for tier in {_tier(len(hashes)), _tier(SIMILARITY * len(hashes))}:
        length = RUN + 3 * max(tier - 1, 0)
        total = reduce(np.add, (np.roll(spread, -i) for i in range(length)))
        found.append(total[hashes % np.uint64(2**tier) == 0] + np.uint64(tier))
    return np.unique(np.concatenate(found))


def _described(text: Column) -> Column:
    """Per text: a hash that names its set of shingles, the set's size, its print, its runs."""

    @F.pandas_udf("id long, size long, print long, runs array<long>")
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = shingles(text if isinstance(text, str) else None)
            name = np.array([xxhash.xxh64_intdigest(found.tobytes(), 1), print_of(found)], np.uint64).view(np.int64)
            rows.append((name[0], len(found), name[1], runs(found).view(np.int64)))
        return pd.DataFrame(rows, columns=["id", "size", "print", "runs"])

    return of_texts(text)


def _shingle_column(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t if isinstance(t, str) else None).view(np.int64) for t in texts], dtype=object)

    return of_texts(text)


def _alike(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of set ids whose whole sets are at least ``SIMILARITY`` alike."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    counts = both.groupBy("id").agg(F.count("*").alias("links"))
    # One text stands for all that have its set.
    wanted = cut_lineage(sets.join(counts, "id").select("id", "text_hash", "links"))
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    whole = cut_lineage(
        texts.join(wanted, "text_hash")
        .dropDuplicates(["id"])
        .select("id", "links", _shingle_column(F.col("text")).alias("set"))
    )
    # A text with many links is copied, so that they are not all checked in one place.
    parts = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(links - 1) div {LINKS}"))))
    spread = pairs.join(counts.select(F.col("id").alias("a"), "links"), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.expr(f"(links - 1) div {LINKS} + 1")).alias("part")
    )
    left = parts.select(F.col("id").alias("a"), "part", F.col("set").alias("set_a"))
    first = spread.join(left, ["a", "part"]).join(counts.select(F.col("id").alias("b"), "links"), "b")
    second = first.withColumn("part", F.pmod(F.xxhash64("a"), F.expr(f"(links - 1) div {LINKS} + 1")))
    right = parts.select(F.col("id").alias("b"), "part", F.col("set").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return cut_lineage(
        second.join(right, ["b", "part"])
        .where(shared >= SIMILARITY * (F.size("set_a") + F.size("set_b") - shared) - 1e-9)
        .select("a", "b")
    )


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, size_a, size_b, print_a, print_b) that sizes and prints do not rule out."""
    sizes = F.least("size_a", "size_b") >= SIMILARITY * F.greatest("size_a", "size_b") - 1e-9
    bits = F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= FAR
    return pairs.where((F.col("a") != F.col("b")) & sizes & bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("*", *[F.col(c).alias(n) for c, n in (("id", side), ("size", f"size_{side}"), ("print", f"print_{side}"))]).drop("id", "size", "print")


def _index_links(sets: DataFrame) -> DataFrame:
    """(a, b): links of the Gray-order index between prints, and of each set to the least with its print."""
    least = cut_lineage(sets.groupBy("print").agg(F.min(F.struct("id", "size")).alias("m")).select("print", "m.id", "m.size"))
    near = simhash.near_links(least.select("print"))
    a, b = _side(least, "a"), _side(least, "b")
    across = near.join(a, near["a"] == a["print_a"]).select("size_a", "print_a", a["a"].alias("first"), near["b"].alias("other"))
    across = across.join(b, F.col("other") == b["print_b"]).select(F.col("first").alias("a"), "size_a", "print_a", "b", "size_b", "print_b")
    within = sets.select("id", "size", "print").join(b, F.col("print") == F.col("print_b"))
    within = within.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("print").alias("print_a"), "b", "size_b", "print_b")
    return _possible(across.unionByName(within))


def _grouped(described: DataFrame) -> DataFrame:
    """run, id, n: the different sets in each group with a common run, of which there are ``n``."""
    chosen = described.groupBy("id").agg(F.min("row").alias("row"))
    rows = described.join(chosen, ["id", "row"], "left_semi").select("id", F.explode("runs").alias("run"))
    # Dealt once, for the counts and for the join with them.
    dealt = rows.repartition("run")
    counts = dealt.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return cut_lineage(dealt.join(counts, "run").select("run", "id", "n"))


def _with_leaders(places: DataFrame, leaders: DataFrame) -> DataFrame:
    """``places`` with the leader (b, root_b) of their group; none of groups without one.

    A group is in parts of about ``TOGETHER`` places, and its leader is copied to each of them.
    """
    last = F.expr(f"n div {TOGETHER}")
    parted = places.withColumn("part", F.pmod(F.xxhash64("id"), last + 1))
    heads = leaders.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).select("run", "part", "b", "root_b")
    group = Window.partitionBy("run", "part")
    both = parted.unionByName(heads, allowMissingColumns=True)
    both = both.withColumns({c: F.max(c).over(group) for c in ("b", "root_b")})
    return both.where("id IS NOT NULL AND b IS NOT NULL").drop("part")


def roots(docs: DataFrame, described: DataFrame) -> DataFrame:
    """(id, root): components of the links between different sets, without those of one set.

    Every group of sets with a common run is led by the one most of whose runs
    are widely shared, such as the text that the others were made from. All
    others are checked against it. Rounds go on with the next leader, of those
    not yet in a leader's component, as long as they find links. A round's pairs are
    at most as many as there are places in groups, never all pairs of a group.
    """
    sets = cut_lineage(
        described.groupBy("id").agg(
            F.min("size").alias("size"),
            F.min("print").alias("print"),
            F.min("text_hash").alias("text_hash"),
            F.min(F.size("runs")).alias("runs"),
        )
    )
    grouped = _grouped(described)
    shared = grouped.groupBy("id").agg(F.sum("n").alias("n")).join(sets, "id")
    weights = shared.select("id", (F.col("n") / F.col("runs")).alias("weight"))
    traits = sets.select("id", "size", "print")
    places = cut_lineage(grouped.join(weights, "id").select("run", "n", "id", "weight", F.lit(False).alias("led"), F.col("id").alias("root")))
    known, tried, found, before = None, None, None, 0
    while True:
        first = F.max(F.struct("weight", "id", "root"))
        leaders = places.where("not led").groupBy("run").agg(first.alias("l"), F.max("n").alias("n"))
        leaders = cut_lineage(leaders.select("run", "n", F.col("l.id").alias("b"), F.col("l.root").alias("root_b")))
        met = _with_leaders(places, leaders).where("root != root_b").select(F.col("id").alias("other"), "b").distinct()
        met = _side(met.join(traits, F.col("other") == F.col("id")), "a").drop("other")
        b = _side(traits, "b")
        pairs = _possible(met.withColumnRenamed("b", "other").join(b, F.col("other") == F.col("b")))
        if tried is None:
            tried = cut_lineage(pairs.unionByName(_index_links(sets)).distinct())
            found = _alike(docs, sets, tried)
        else:
            pairs = cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"))
            tried, found = tried.unionByName(pairs), found.unionByName(_alike(docs, sets, pairs))
        count = found.count()
        if known is not None and count == before:
            return known
        before = count
        known = cut_lineage(components(found).select(F.col("node").alias("id"), "root"))
        if not count:
            return known
        # Places in the component of a leader have been led; groups that are led throughout get no leader any more.
        named = leaders.select("run", "n", "b").join(known.withColumnsRenamed({"id": "b", "root": "root_b"}), "b", "left")
        named = named.select("run", "n", "b", F.coalesce("root_b", "b").alias("root_b"))
        now = places.drop("root").join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
        led = F.col("led") | (F.col("root") == F.col("root_b"))
        places = cut_lineage(_with_leaders(now, named).select("run", "n", "id", "weight", led.alias("led"), "root"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and root (a number that names the component) of every row of ``docs`` (doc_id, text).

    Texts are linked if at least ``SIMILARITY`` of their different ``WORDS``-word
    shingles are shared. Texts of fewer words have one shingle, the whole
    sequence; texts without words (null, empty, white space) are alike.
    """
    described = cut_lineage(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _described(F.col("text")).alias("d"))
        .select("doc_id", "text_hash", "d.*")
        .withColumn("row", F.monotonically_increasing_id())
    )
    known = roots(docs, described)
    return described.select("doc_id", "text_hash", "id").join(known, "id", "left").select("doc_id", "text_hash", F.coalesce("root", "id").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component, as ``simhash.keep_one`` chooses it."""
    return simhash.keep_one(docs, classes)
