"""Connected components by contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arauto.llm.common import staged

#: Pointer jumps of one round.
JUMPS = 2


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); a component is named by its smallest node.

    Each round every node points at its smallest neighbour (or itself), pointers are followed a few steps, edges move to
    what their ends point at, and those within one node go. Nodes at least halve, so rounds grow with the logarithm.
    Neighbours meet only in a minimum, which is taken partially before the shuffle; a hub is never gathered. Each
    round is written to the shared folder.
    """
    edges = staged(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), name)
    labels = None
    while not edges.isEmpty():
        ends = edges.union(edges.select(F.col("b"), F.col("a")))
        points = staged(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), name)
        for _ in range(JUMPS):
            jump = points.select(F.col("node").alias("to"), F.col("to").alias("far"))
            points = points.join(jump, "to").select("node", F.col("far").alias("to"))
        points = staged(points, name)
        if labels is None:
            labels = points.select("node", F.col("to").alias("component"))
        else:
            step = points.select(F.col("node").alias("component"), "to")
            labels = staged(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), name)
        moved = edges.join(points.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(points.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = staged(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
