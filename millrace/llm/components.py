"""Connected components of a graph held in DataFrames, by alternating large and small stars.

A round takes every node to the least of its neighbourhood, which about squares the reach of a node, so paths of n nodes
settle in some log2 n rounds. ROUNDS is enough for more nodes than any table has rows; not settling by then is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ROUNDS = 40


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b) with a > b: links of a node are moved to the least node it is linked to."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    moved = both.join(least, "a")
    found = moved.where("b > a" if large else "b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        found = found.unionByName(least.select("a", F.col("least").alias("b")))
    return found.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the least node of its component.

    Null ends and loops are dropped; repeated links count once. Each round writes what it found to the shared folder.
    """
    pairs = shared.written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        pairs = shared.written(_star(_star(pairs, True), False), "stars")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
