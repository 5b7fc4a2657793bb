"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def _least_first(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges(a, b)``; the label is the component's smallest node.

    Each round points every node to its smallest neighbour, follows the pointers
    to their ends by doubling, and contracts the edges; so at least half of the
    nodes that still have an edge go, in chains as well. Rounds are kept in the
    shared folder; only whether edges are left reaches the driver.
    """
    left = settle(_least_first(edges))
    found = None
    while found is None or left.limit(1).count():
        both = left.union(left.select("b", "a"))
        move = to_ends(settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))))
        if found is None:
            found = move.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            step = move.select(F.col("a").alias("label"), "to")
            found = settle(found.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        a, b = move.select("a", F.col("to").alias("to_a")), move.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved = left.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        left = settle(_least_first(moved))
    return found


def to_ends(move: DataFrame) -> DataFrame:
    """Pointers (a, to), each to itself or a smaller node, followed to their ends."""
    while True:
        onward = move.select(F.col("a").alias("to"), F.col("to").alias("end"))
        # a pointer to the end of its chain has nowhere to go
        if not move.join(onward.where("end < to"), "to", "left_semi").limit(1).count():
            return move
        move = settle(move.join(onward, "to").select("a", F.col("end").alias("to")))
