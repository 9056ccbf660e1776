"""Connected components of a link table by alternating large-star and small-star steps.

Each step replaces links by links to the smallest neighbour. Steps are aggregations and joins keyed by a node, each is
written to the shared folder, and the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. large: neighbours above a node go to its least neighbour; else those below it do."""
    if large:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        below = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = below.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(b, a) >> 16"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the least node that can be reached."""
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = materialize(_star(_star(now, True), False), "links")
        before, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
