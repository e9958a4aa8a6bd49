"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritpool.llm.frames import landed


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links (v, u), v > u, pointed at the smallest neighbour of their centre.

    The smallest neighbour of a node is a map-side combined minimum, joined back;
    both sides of the join come from exchanges Spark can split, so a node with a
    large part of all links doesn't fill one task.
    """
    if large:
        around = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        centre = around.select(F.col("v").alias("c"), F.col("u").alias("n"))
    else:
        centre = edges.select(F.col("v").alias("c"), F.col("u").alias("n"))
    least = centre.groupBy("c").agg(F.least(F.min("n"), F.col("c")).alias("m")).hint("rebalance")
    joined = centre.join(least, "c")
    if large:
        out = joined.where("n > c").select(F.col("n").alias("v"), F.col("m").alias("u"))
    else:
        out = joined.select(F.col("n").alias("v"), F.col("m").alias("u")).union(
            least.select(F.col("c").alias("v"), F.col("m").alias("u"))
        )
    return out.where("v > u").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (v, u) of longs.

    root is the smallest node that can be reached. Self links and repeated links
    are allowed and change nothing; an empty frame gives an empty frame. Each
    round is written down, so lost executors cost one round at most.
    """
    links = landed(
        edges.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).where("v > u").distinct()
    )
    mark = _mark(links)
    while mark[0]:
        links = landed(_stars(_stars(links, True), False))
        now = _mark(links)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Two counts that stay as they are only if the links do."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
