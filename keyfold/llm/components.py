"""Connected components of a table of links, by alternating star steps.

Each round turns every node's links to its smallest neighbour, first towards
larger then towards smaller nodes, until all components are stars.  A round is
two grouped minima and two joins over the links; its result is written to the
shared folder.  Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` has a < b; each b's links go to its smallest a."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    return (
        moved.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        .unionByName(least.select(F.col("m").alias("a"), "b"))
        .distinct()
    )


def _are_stars(links: DataFrame) -> bool:
    """Has every b one a, which is no b itself?"""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high"))
    )
    per_node = ends.groupBy("node").agg(F.max("low").alias("low"), F.sum("high").alias("high"))
    return per_node.where("high > 1 OR low = 1 AND high = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, label)``: each linked node's smallest reachable node."""
    links = materialise(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    while not _are_stars(links):
        links = materialise(_small_star(_large_star(links)), "links")
    return links.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    )
