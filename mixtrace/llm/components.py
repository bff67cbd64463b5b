"""Connected components of a link table, by alternating stars.

Each round rewires every node's neighbours to the smallest node it knows
(large star: the greater neighbours, small star: the smaller ones), which
keeps the components and ends in stars after few rounds, also for long chains.
All steps are aggregates with partial sums and equi-joins, so a node with very
many links is no single task's work; the links are checkpointed every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b) -> the star step's links (a > b), distinct."""
    if large:  # every node sees all neighbours; the greater ones go to its minimum
        seen = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = links.select(F.col("b").alias("a"), F.col("a").alias("v")).join(low, "a").select(
            F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # every node sees its smaller neighbours; they and itself go to their minimum
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.filter("a != b").union(low.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """a, b (longs, any order) -> node, component (its smallest reachable node),
    for every node that has a link to another.  Rounds go on until nothing changes."""
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    last = now.agg(mark.alias("m")).first().m
    while True:
        now = cut(_star(_star(now, True), False))
        new = now.agg(mark.alias("m")).first().m
        if new == last:
            return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
                    .union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
        last = new
