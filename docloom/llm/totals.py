"""Prefix sums over tables of any size and any skew."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.session import cut_lineage


def sums_before(df: DataFrame, order: list[Column], values: Mapping[str, str]) -> DataFrame:
    """Add for each long column a column: its sum over all rows that come before in ``order``.

    ``values`` maps the new names to the columns that are summed; nulls count
    as 0. Rows are range-partitioned and sorted, each task keeps a running sum
    of its range, and only one total per range is brought together. Rows that
    tie in ``order`` follow each other in any sequence.
    """
    schema = StructType(list(df.schema.fields))
    for name in values:
        schema = schema.add(name, "long")
    schema = schema.add("_range", "integer")

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, reached = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for batch in batches:
            for name, column in values.items():
                own = batch[column].fillna(0).to_numpy(np.int64)
                upto = reached[name] + np.cumsum(own)
                batch[name] = upto - own
                if len(own):
                    reached[name] = int(upto[-1])
            batch["_range"] = part
            yield batch

    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(sorted_rows.mapInPandas(running, schema))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("_range").agg(
        *[F.max(F.col(n) + F.coalesce(F.col(c), F.lit(0))).alias(f"_end_{n}") for n, c in values.items()]
    )
    # One row per range: as many as there were tasks.
    starts = ends.select(
        "_range", *[F.coalesce(F.sum(f"_end_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in values]
    )
    return ranged.join(F.broadcast(starts), "_range").select(
        *df.columns, *[(F.col(n) + F.col(f"_start_{n}")).alias(n) for n in values]
    )
