"""Connected components of an edge table by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), of any one type; a component is named by one of its nodes.

    In each round every node follows the neighbour (or itself) of least random rank, twice; edges are then redrawn
    between the nodes reached. About a constant share of the nodes disappears a round, whatever the shape, and a star
    is gone after at most two. Each round's tables are durable and go when the next round's are there. A table without edges
    gives no nodes.
    """
    left = durable(edges.select("a", "b").where("a <> b").distinct(), "edges")
    held, turn = None, 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("r"), F.col(c).alias("n"))  # noqa: B023, E731
        both = left.union(left.select("b", "a"))
        follows = durable(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least(rank("a"), rank("b")))["n"].alias("to")), "follows")
        twice = follows.alias("f").join(follows.alias("g"), F.col("f.to") == F.col("g.node")).select(F.col("f.node").alias("node"), F.col("g.to").alias("to"))
        twice = durable(twice, "twice")
        if held is None:
            now = twice.select("node", F.col("to").alias("component"))
        else:
            now = held.join(twice.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        before, held = held, durable(now, "held")
        ends = left.join(twice.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(twice.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        old, left = left, durable(ends.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(), "edges")
        release(follows, twice, old, *([before] if before is not None else []))
        turn += 1
    if held is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return held
