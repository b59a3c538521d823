"""Connected components of a link table by repeated contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for all ends of links (a, b: long); component is the smallest node that can be reached.

    Each round maps every node to its neighbour (or itself) that comes first in a random order of that round, and
    contracts the links accordingly; a constant share of the nodes vanishes each time, so rounds grow with the
    logarithm of the number of nodes. Minima are pre-aggregated, so a hub's links don't meet in one task.
    """
    edges = common.cut(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    place = common.cut(ends.withColumn("at", F.col("node")))
    turn = 0
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        order = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("o"), F.col(c).alias("id"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("best")).select(F.col("a").alias("old"), F.when(F.col("best") < order("a"), F.col("best.id")).otherwise(F.col("a")).alias("new"))
        hop = common.cut(first)
        # one jump more: where my new node itself moves on
        jump = hop.select(F.col("old").alias("new"), F.col("new").alias("newer"))
        step = common.cut(hop.join(jump, "new", "left").select("old", F.coalesce("newer", "new").alias("new")))
        moved = common.cut(place.join(step, place["at"] == step["old"], "left").select("node", F.coalesce("new", "at").alias("at")))
        ends = edges.join(step.select(F.col("old").alias("a"), F.col("new").alias("x")), "a").join(step.select(F.col("old").alias("b"), F.col("new").alias("y")), "b")
        merged = common.cut(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        common.forget(edges, place, hop, step)
        edges, place, turn = merged, moved, turn + 1
    least = place.groupBy("at").agg(F.min("node").alias("component"))
    return common.cut(place.join(least, "at").select("node", "component"))
