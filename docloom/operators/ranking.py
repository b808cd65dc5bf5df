"""Dense numbers over data of any size and any skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage


# Layout of monotonically_increasing_id: the low bits are the place in the partition.
PLACE_BITS = 33


def number_rows(
    df: DataFrame, name: str, order: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: 1, 2, ... by ``order`` inside each ``within`` group.

    Rows are range-partitioned and sorted once, so a group larger than a task
    spans several partitions. A row's number is its place in its partition plus
    the counts of the partitions before; only one count per partition and group
    is brought together.
    """
    keys, groups = [*within, *order], list(within)
    # The generated id is the partition's number and the place in the partition.
    placed = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", PLACE_BITS))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        placed.groupBy(*groups, "_part")
        .agg(F.count("*").alias("_rows"), F.min("_at").alias("_start"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return (
        placed.join(spans, [*groups, "_part"])
        .withColumn(name, F.col("_at") - F.col("_start") + 1 + F.col("_offset"))
        .drop("_at", "_part", "_start", "_offset")
    )


def last_wins(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The row with the greatest ``sequence`` of every key.

    An aggregate with a partial step: copies of a hot key shrink to one row
    per task before the exchange.
    """
    others = [c for c in df.columns if c not in keys]
    kept = F.max_by(F.struct(*others), F.col(sequence)).alias("_kept")
    return df.groupBy(*keys).agg(kept).select(*keys, *[F.col(f"_kept.{c}").alias(c) for c in others])


def best_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, spread: str, name: str, slices: int = 64
) -> DataFrame:
    """First ``k`` rows of every group, numbered from 1 in ``name``.

    Two rounds: a group is first cut to ``k`` rows inside ``slices`` of
    itself, so that no task ever holds a whole hot group. One slice is for
    groups known to be small, and takes one round.
    """
    final = Window.partitionBy(*group).orderBy(*order)
    if slices == 1:
        return df.withColumn(name, F.row_number().over(final)).where(F.col(name) <= k)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int"))
    first = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.withColumn(name, F.row_number().over(first))
        .where(F.col(name) <= k)
        .drop("_slice")
        .withColumn(name, F.row_number().over(final))
        .where(F.col(name) <= k)
    )
