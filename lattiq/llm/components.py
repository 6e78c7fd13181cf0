"""Connected components of an edge table: smallest-label spreading with pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import Workspace


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node id reachable.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label; rounds grow with the logarithm of the diameter.
    """
    both = space.settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = space.settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels.node == near.a, "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        above = labels.select(F.col("node").alias("low"), F.col("comp").alias("above"))
        jumped = low.join(above, "low", "left").select("node", F.least("low", F.coalesce("above", "low")).alias("comp"), (F.least("low", F.coalesce("above", "low")) < F.col("comp")).alias("moved"))
        step += 1
        settled = space.settle(jumped, f"{name}-{step}")
        space.drop(f"{name}-{step - 1}")
        labels = settled.select("node", "comp")
        if settled.filter("moved").isEmpty():
            space.drop(f"{name}-edges")
            return labels
