"""Mix sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.totals import sums_before
from docloom.session import cut_lineage

# Marks that prose rarely holds; their share lowers a document's weight.
MARKS = "#$%&*!|"
# Hex digits of the md5 that make the random number: 52 bits, exact in a double.
DIGITS, SPAN = 13, float(1 << 52)


def prose_weight(text: Column) -> Column:
    """1 for prose without marks, down to 1/21 for nothing but marks; 1 for a null or empty text."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    share = marks / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * share), F.lit(1.0))


def source_targets(
    sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = (3, 1, 2)
) -> DataFrame:
    """Targets of ``sources`` (source, source_size), with ``first``: the sizes of the sources before.

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` times all sizes by weight. A target stops at ``most`` times the
    source's size and the excess goes to the others by weight, until none is
    above. That ends where each target is ``min(most * size, level * weight)``:
    with sources sorted by ``most * size / weight``, the level is what is left
    after all sources before, over their remaining weight, at the first source
    that it does not exceed. If every size is 0, so is every target.
    """
    ranked = sums_before(
        sources.withColumn("_one", F.lit(1).cast("long")),
        [F.col("source").asc_nulls_last()],
        {"_rank": "_one", "first": "source_size"},
    )
    turns = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    weighed = ranked.withColumn("_weight", F.element_at(turns, (F.col("_rank") % len(weights) + 1).cast("int")))
    limit = F.lit(float(most)) * F.col("source_size")
    ratio = limit / F.col("_weight")
    filled = sums_before(
        weighed.withColumn("_ratio", ratio),
        [F.col("_ratio"), F.col("_rank")],
        {"_full": "source_size", "_used": "_weight"},
    )
    total = filled.agg(F.sum("source_size").alias("s"), F.sum("_weight").alias("w")).first()
    size, weight = int(total["s"] or 0), int(total["w"] or 0)
    level = (F.lit(share * size) - F.lit(float(most)) * F.col("_full")) / (F.lit(float(weight)) - F.col("_used"))
    fits = filled.withColumn("_level", level).where(F.col("_level") <= F.col("_ratio"))
    found = fits.agg(F.min_by("_level", F.struct("_ratio", "_rank")).alias("level")).first()["level"]
    target = limit if found is None else F.least(limit, F.lit(found) * F.col("_weight"))
    return filled.select("source", "source_size", "first", target.alias("target"))


def mix(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = (3, 1, 2)
) -> DataFrame:
    """Words that a mix takes of each row of ``docs`` (doc_id, source, size, weight).

    A source's target is spent in complete epochs first: every document as
    often as the source fits whole. The rest is drawn by Efraimidis and
    Spirakis: the key of a document is an exponential number, from the md5 of
    its id, over its weight; documents are taken by growing key until the sum
    of their sizes reaches the rest, and the last is cut to fit. So a source's
    taken words are its target, rounded down.

    Rows with a null source are a source of their own, the last. A null size is
    0 and takes 0. Repeated rows each count and are taken one after the other;
    ties go to the smaller doc_id (null first), then the smaller size. An empty
    table gives no rows. Other columns are left out, whatever their names.
    """
    n = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, DIGITS), 16, 10)
    key = -F.log((n.cast("long") + F.lit(0.5)) / F.lit(SPAN)) / F.col("weight")
    rows = cut_lineage(
        docs.select(
            "doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), key.alias("_key")
        )
    )
    sources = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = cut_lineage(source_targets(sources, share, most, weights))
    # One order over all sources: a hot source is many ranges.
    placed = sums_before(
        rows,
        [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id").asc_nulls_first(), F.col("size")],
        {"_before": "size"},
    ).withColumnRenamed("source", "_source")
    joined = placed.join(targets, F.col("_source").eqNullSafe(F.col("source")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    left = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_before") - F.col("first"))))
    return joined.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + left).cast("long").alias("taken")
    )
