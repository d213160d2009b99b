"""Connected components of a link table by alternating large and small stars.

Each round is two grouped minima and two joins, written to the shared folder.
Nodes are longs; a node's links meet by map-side minima, so a hub with very many
links sends one partial minimum per task, and hubs meet their links by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaforge.llm.common import cut, meet


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(near: DataFrame, centre: DataFrame) -> DataFrame:
    return meet(near, centre, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour is linked to the least of a node's neighbourhood."""
    near = _both(links)
    centre = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("_rows"))
    return _star(near.filter(F.col("b") > F.col("a")), cut(centre))


def _small(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node and the node itself are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    centre = cut(down.groupBy("a").agg(F.min("b").alias("m"), (F.count(F.lit(1)) + 1).alias("_rows")))
    own = centre.select("a", F.col("a").alias("b"))
    return _star(down.union(own), centre)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each linked node reaches. `links` has long columns a and b; single nodes are absent."""
    now = cut(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a != b").select("a", "b").distinct())
    sign = lambda f: tuple(f.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(now)
    while True:
        now = cut(_small(cut(_large(now))))
        after = sign(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
