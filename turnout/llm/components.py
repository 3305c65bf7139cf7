"""Connected components of a distributed graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    out = both.join(low, "a").where("b > a")
    return out.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    out = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return out.union(low.select("a", F.col("low").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; ``edges`` has long columns a and b.

    Each round replaces links by links to a smaller node (large star, then small star), which
    ends after about log(n) rounds in stars around the smallest node. Rounds are written to the
    shared folder. Minima combine before the shuffle and the joins are plain equi-joins, which
    adaptive execution splits where a hub is hot. Null ends are ignored.
    """
    current = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"),
                                                  F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(current)
    while seen[0]:
        current = stored(_small_star(_large_star(current)), "links")
        now = mark(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
