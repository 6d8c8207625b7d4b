"""Connected components over a table of links, by contraction to the smallest neighbour (large and small stars in turn)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, scratch


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it is linked to) of each node that has a link; ``links`` has longs a and b.

    Each round hangs every node's larger neighbours under its smallest one, then every node and its smaller neighbours under the
    smallest of them.  A hub of many links costs partial sums, not one large group: neighbours are joined with the minimum of
    their node, and no list of neighbours is ever built.  The number of rounds grows with the logarithm of the size.
    """
    with scratch(links.sparkSession) as keep:
        edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        if edges.isEmpty():
            return keep(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))
        while True:
            edges, done = _round(edges)
            if done:
                return keep(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))


def _round(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges (node, smaller node) after a large and a small star, and whether every node hangs under one root that hangs under none."""
    with scratch(edges.sparkSession) as keep:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")))      # a table: hubs of a join with it can be split
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
        large = cut_lineage(large.distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = keep(small)
    open_nodes = after.groupBy("u").count().where("count > 1").select("u")
    roots = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return after, open_nodes.isEmpty() and roots.isEmpty()
