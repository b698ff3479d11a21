"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's greater neighbours move to its least neighbour. Small star: its lesser ones and itself do."""
    if large:
        seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = seen.join(least, "a")
    if large:
        moved = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of a link (a, b) of longs.

    Links that repeat, point both ways or to themselves are fine; no links give no rows. The links of
    a round are written to the checkpoint folder; only a count and a checksum come to the driver.
    """
    now = checkpointed(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = checkpointed(_star(_star(now, True), False))
    # every link is now (node, component)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
