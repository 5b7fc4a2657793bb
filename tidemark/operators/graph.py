"""Connected components and ordered leaders of edge tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """A table computed once and kept in the session's checkpoint folder; without one, an error off local mode."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges(a, b)``; the label is the component's smallest node.

    Each round points every node to its smallest neighbour, follows the pointers
    to their ends by doubling, and contracts the edges; so at least half of the
    nodes that still have one go, in chains as well.
    """
    sorted_ = lambda df: kept(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found, left = kept(nodes.select("node", F.col("node").alias("label"))), sorted_(edges)
    while left.limit(1).count():
        near = left.union(left.select("b", "a")).groupBy(F.col("a").alias("from")).agg(F.min("b").alias("near"))
        point = to_ends(kept(near.select("from", F.least("from", "near").alias("to"))))
        found = kept(found.join(point, found["label"] == point["from"], "left").select("node", F.coalesce("to", "label").alias("label")))
        ends = [point.select(F.col("from").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b")]
        left = sorted_(left.join(ends[0], "a").join(ends[1], "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")))
    return found


def to_ends(point: DataFrame) -> DataFrame:
    """Pointers (from, to), each to itself or a smaller node, followed to their ends."""
    while True:
        onward = point.select(F.col("from").alias("to"), F.col("to").alias("end"))
        jumped = kept(point.join(onward, "to").select("from", F.col("end").alias("to"), (F.col("end") < F.col("to")).alias("moved")))
        point = jumped.select("from", "to")
        if not jumped.where("moved").limit(1).count():
            return point


def leaders(items: DataFrame, pairs: DataFrame, sure: DataFrame | None = None) -> DataFrame:
    """(pos, leader): items (pos) in order of ``pos``, each joining the first leader that it is paired with, or leading; those in ``sure`` (pos) lead.

    ``pairs`` (a, b, with a before b) are the like items. A round settles every
    item whose earlier partners are settled far enough: it follows if one of
    them leads, and leads if none of them is open or leads.
    """
    state = items.select("pos", F.lit("open").alias("state"))
    if sure is not None:
        state = items.select("pos").join(sure.select("pos", F.lit("leads").alias("sure")), "pos", "left").select("pos", F.coalesce("sure", F.lit("open")).alias("state"))
    state = kept(state)
    while True:
        earlier = pairs.join(state.select(F.col("pos").alias("a"), F.col("state").alias("before")), "a").groupBy(F.col("b").alias("pos"))
        seen = earlier.agg(F.bool_or(F.col("before") == "leads").alias("some"), F.bool_or(F.col("before") == "open").alias("wait"))
        now = F.when(F.col("state") != "open", F.col("state")).when(F.coalesce("some", F.lit(False)), "follows").when(F.coalesce("wait", F.lit(False)), "open").otherwise("leads")
        state = kept(state.join(seen, "pos", "left").select("pos", now.alias("state")))
        if not state.where("state = 'open'").limit(1).count():
            break
    lead = state.where("state = 'leads'").select(F.col("pos").alias("a"))
    first = pairs.join(lead, "a").groupBy(F.col("b").alias("pos")).agg(F.min("a").alias("leader"))
    return state.join(first, "pos", "left").select("pos", F.when(F.col("state") == "leads", F.col("pos")).otherwise(F.col("leader")).alias("leader"))
