"""Connected components by randomised contraction.

In a round every node takes the smallest random number of that round within two steps of it, and edges are renamed by what their ends
took. A star collapses in one round; otherwise the expected number of nodes falls by a constant factor, chains included. Nothing but the
answer whether edges are left reaches the driver. Joins on a node with very many edges are plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaflow.llm.common import release, stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes that have an edge. ``edges``: a and b, long."""
    edges = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        salt = F.lit(len(steps))
        both = edges.union(edges.select("b", "a"))
        drawn = lambda node: F.struct(F.xxhash64(node, salt).alias("h"), F.col(node).alias("to"))  # noqa: E731, B023
        near = both.groupBy("a").agg(F.min(drawn("b")).alias("m")).select(F.col("a").alias("b"), F.least("m", drawn("a")).alias("m"))
        # a neighbour's minimum covers the node itself and, over all neighbours, everything two steps away
        step = stored(both.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("m")["to"].alias("to")), "hooks")
        steps.append(step)
        before = edges
        for side in ("a", "b"):
            edges = edges.join(step.withColumnsRenamed({"node": side}), side).drop(side).withColumnRenamed("to", side)
        edges = stored(edges.where("a != b").distinct(), "edges")
        release(before)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps[-1]
    for step in reversed(steps[:-1]):
        later = labels.select(F.col("node").alias("to"), F.col("to").alias("last"))
        labels = step.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    labels = stored(labels, "labels")
    release(edges, *steps)
    names = labels.groupBy("to").agg(F.min("node").alias("component"))
    found = stored(labels.join(names, "to").select("node", "component"), "components")
    release(labels)
    return found
