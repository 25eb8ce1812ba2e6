"""Connected components of a distributed edge list by contraction in random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (a, b longs).

    In each round every vertex of the contracted graph moves to the least of itself and its neighbours, and edges
    inside a vertex go. Vertices get new numbers every round, by a one-to-one scrambling of 64-bit values, so "least"
    is a random choice: a path or star loses a constant part of its vertices a round, however its ids are ordered. Each
    round is written to the shared folder, and nothing of the graph reaches the driver.
    """
    scrambled = lambda c: F.xxhash64(c)  # noqa: E731  (one-to-one on single longs)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = staged(both.filter("a <> b").select(scrambled("a").alias("a"), scrambled("b").alias("b")).distinct())
    labels = staged(both.select("a").distinct().select(F.col("a").alias("node"), scrambled("a").alias("component")))
    while not live.isEmpty():
        least = staged(live.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        moved = labels.join(least, labels["component"] == least["a"], "left")
        next_labels = staged(moved.select("node", scrambled(F.coalesce("to", "component")).alias("component")))
        first = live.join(least, "a").select(F.col("to").alias("x"), "b")
        second = first.join(least.select(F.col("a").alias("b"), "to"), "b").filter("x <> to")
        next_live = staged(second.select(scrambled("x").alias("a"), scrambled("to").alias("b")).distinct())
        discard(labels, live, least)
        labels, live = next_labels, next_live
    named = labels.join(labels.groupBy("component").agg(F.min("node").alias("least")), "component")
    out = staged(named.select("node", F.col("least").alias("component")))
    discard(live, labels)
    return out
