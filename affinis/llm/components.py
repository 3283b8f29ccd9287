"""Connected components of a table of links, by large-star and small-star steps.

Every step is a keyed aggregation and a join with one row for each key, so a node with very many links can be split; no links
or labels reach the driver, only a count and a checksum that tell when nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from affinis.session import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node linked with the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours linked with the smallest of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), long: root is the smallest node that links lead to. Null ends, loops and repeated
    links do no harm; no links give no rows."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while True:
        edges = materialise(_small(_large(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
