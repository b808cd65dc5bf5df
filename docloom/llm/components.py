"""Connected components of links between numbers, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root the smallest node of its component.

    Large-star and small-star steps by turns: every node hands its larger
    neighbours, then its smaller ones, to the smallest node that it knows.
    A step is one aggregate with a partial step and one join, which Spark
    splits at hot nodes; no node's neighbours are ever gathered. It ends when
    all links are stars, after about log(nodes) rounds.
    """
    pairs = links.where(F.col("a") != F.col("b"))
    edges = cut_lineage(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        if _all_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, or has links to larger ones only."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return nodes.where((F.col("up") > 1) | (F.col("up") > F.col("least"))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to its smallest neighbour or itself."""
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    others = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
