"""Connected components of links by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import staged

MOST_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link downwards or only links from above, so that all components are stars."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionAll(links.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    sums = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return sums.where("down > 1 OR (down = 1 AND up = 1)").limit(1).count() == 0


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Links have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least.hint("merge"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link to another; the component is the least node reachable.

    `links` has integer columns `a` and `b` in any direction; nulls, repeats and a = b count as no link. A hub's links
    are joined with its least neighbour rather than collected, so Spark can split them; no side is broadcast, however small its file looks.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = staged(ordered.distinct(), "links")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            ends = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(ends)
        now = staged(_small_star(_large_star(now)), "links")
    raise RuntimeError("components did not settle")
