"""Connected components of a link table by alternating large and small stars. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


#: Least neighbours of the nodes of so many edges are broadcast, so that a node with many neighbours isn't one task's.
FEW_EDGES = 150_000


def _round(edges: DataFrame, few: bool) -> DataFrame:
    """edges (u > v). Large star: greater neighbours go to the least one; small star: so do the others."""
    told = F.broadcast if few else lambda df: df
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = told(_min_neighbour(both).withColumn("m", F.least("u", "m")))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    joined = large.join(told(_min_neighbour(large)), "u")
    small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return small.distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b of any ordered type. Returns node, root for every linked node; root is the component's least node.

    Ends when a round changes no edge: then every component is a star. The number of rounds grows with the
    logarithm of the longest path."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        edges = materialize(_round(edges, now[0] <= FEW_EDGES), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
