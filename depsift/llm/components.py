"""Connected components of a table of links, by alternating large and small stars.

Each step replaces the links of a node by links to the smallest of its
neighbours; the links shrink to one star a component in a logarithmic number of
steps.  Nothing is collected: a step is a partially aggregated minimum and a join
back, which adaptive execution splits where one node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.llm.shared import drop_kept, keep


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least of a node and its neighbours: those above the
    node (large), or those below it and the node itself (small)."""
    near = _both_ways(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = near.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): every node that has a link, with the least node it reaches."""
    links = keep(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        after = keep(_star(_star(links, large=True), large=False), "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop_kept(links)
        links = after
        if tuple(state) == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = tuple(state)
