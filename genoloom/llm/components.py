"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.session import cut_lineage


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node and the smallest node it reaches.

    ``links`` has long columns a and b.  Every half round hangs each node's neighbours on
    their smallest one; tables are written between, so that a node with very many links
    is a splittable side of a join and lost executors reread files.  The rounds grow with
    the logarithm of the longest chain.  Nodes without links are left out.
    """
    edges = cut_lineage(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _print(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        low = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = cut_lineage(both.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _print(edges)
        if now == seen:
            break
        seen = now
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
