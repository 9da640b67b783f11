"""Connected components of a link table, and the small in-task forest that keeps link tables short."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from framelane.llm.shared import checkpointed


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that join the same nodes as the links (u, v); fewer than nodes."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links`` (``u``, ``v`` long, either direction, repeats allowed).

    Each round every node, and the node it points to, takes the smallest label next to it, then labels are followed one step; the
    number of rounds grows with the logarithm of the longest chain. Tables are written to the shared checkpoint folder between
    steps, so a lost executor costs one step, and joins read plain tables whose hot keys Spark can split. The driver
    sees one number per round.
    """
    down = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    lows = checkpointed(down.groupBy("u").agg(F.min("v").alias("low")))
    # many links of one node become links of its lower neighbours with the lowest, which other nodes share
    ends = F.explode(F.array(F.col("u"), F.col("v"))).alias("u")
    short = down.join(lows, "u").select(ends, "low").filter("u <> low").distinct()
    both = checkpointed(short.select("u", F.col("low").alias("v")).union(short.select("low", "u")))
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("_next")), "v").groupBy(F.col("u").alias("node")).agg(F.min("_next").alias("_next"))
        offers = labels.join(near, "node").filter(F.col("_next") < F.col("component"))
        moves = offers.select(F.explode(F.array(F.col("node"), F.col("component"))).alias("node"), "_next").groupBy("node").agg(F.min("_next").alias("_next"))
        hooked = checkpointed(labels.join(moves, "node", "left").select("node", F.least("component", "_next").alias("component"), F.col("_next").isNotNull().alias("_moved")))
        ahead = hooked.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        followed = checkpointed(hooked.join(ahead, "component").select("node", F.col("_far").alias("component"), (F.col("_moved") | (F.col("_far") < F.col("component"))).alias("_moved")))
        labels = followed.drop("_moved")
        if followed.filter("_moved").isEmpty():
            return labels
