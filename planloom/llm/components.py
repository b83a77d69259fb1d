"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.session import forget, written


def _star(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """Link every neighbour to the lowest node around ``u``."""
    return edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u, v); root: its component's smallest node.

    Each round replaces links by links to smaller nodes; they are stars when no node has two smaller
    neighbours, or a smaller and a larger one. Rounds grow with the logarithm of a component's width. A round
    counts, joins and writes only links, as Parquet in the shared checkpoint folder (few links are read by few tasks), and
    deletes the files of the round before; nodes with very many links are split by the adaptive skew join,
    as both sides of a join of many links are shuffled.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # u > v in every link of ``edges``
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        n_smaller, n_larger = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        low = written(edges.unionByName(turned).groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("low"),
            ((n_smaller > 1) | ((n_smaller > 0) & (n_larger > 0))).alias("open")))
        if low.where("open").isEmpty():
            forget(low)
            break
        large = written(_star(turned, low).where("u <> v").distinct())
        lowest = written(large.groupBy("u").agg(F.min("v").alias("low")))
        near = _star(large, lowest).unionByName(lowest.select("u", F.col("low").alias("v")))
        found = written(near.where("u <> v").distinct())
        for done in (edges, low, large, lowest):
            forget(done)
        edges = found
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
