"""Connected components of a graph given as links between 64-bit nodes, by alternating large and small stars.

Each round hangs every node on the smallest neighbour it knows, first from the side of the larger neighbours, then from
the side of the smaller; the rounds end when the links are the same as before, compared link by link. Only aggregations by
node and joins with one row per node on one side are used, so a node with very many links is pre-aggregated and its join
partition can be split. Links and labels stay in written tables, deleted when the next round has its own; three numbers a
round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, spread_join, written


def star_labels(links: DataFrame) -> DataFrame:
    """node, root for every node with a link. ``links``: columns a, b; loops and repeats are allowed."""
    links = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    ended = links.isEmpty()
    while not ended:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "large_least")
        large = spread_join(links.select(F.col("b").alias("a"), F.col("a").alias("b")), least.drop("n"), "a", "b", counts=least.select("a", "n"))
        large = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large_star", least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "small_least")
        small = spread_join(large, least.drop("n"), "a", "b", counts=least.select("a", "n")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, links = links, written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small_star", large, least)
        ended = old.count() == links.count() and links.join(old, ["a", "b"], "left_anti").isEmpty()
        forget(old)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
