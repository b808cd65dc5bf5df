"""Vector expressions. Stored vectors are ``ARRAY<FLOAT>``; sums run in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.lets import let

# Distances are compared at this many decimals, so that exact copies tie and
# fall back to their ids whatever the order of summation.
RANK_DECIMALS = 12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL if a vector is NULL, NaN if one is zero, an error if the widths differ."""
    scaled = let(
        norm(a) * norm(b),
        lambda n: F.when(n == 0, F.lit(float("nan"))).otherwise(
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))
        ),
    )
    widths = F.concat_ws(" and ", F.size(a).cast("string"), F.size(b).cast("string"))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("different vector dimensions "), widths)))
        .otherwise(scaled)
    )

