"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import written


def _flat(parents: DataFrame) -> DataFrame:
    """Follow parents up to the root of each tree; a parent is smaller than its child."""
    while True:
        up = parents.select(F.col("u").alias("w"), F.col("p").alias("q"))
        step = written(
            parents.join(up, F.col("p") == F.col("w"), "left").select(
                "u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")
            ),
            "parents",
        )
        parents = step.select("u", "p")
        if step.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round, every node hangs below its smallest smaller neighbour, trees are flattened by
    pointer jumping, and edges move to the roots. Both halve what is left at least, so the number
    of rounds grows with the logarithm of the longest path. Aggregates combine before the shuffle
    and joins have one row per node on one side, so a node with many edges is no bottleneck.
    """
    left = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    nodes = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
    labels = written(nodes.withColumn("component", F.col("node")), "labels")
    while not left.isEmpty():
        parents = _flat(left.groupBy("u").agg(F.min("v").alias("p")))
        up = parents.select(F.col("u").alias("w"), "p")
        labels = written(
            labels.join(up, F.col("component") == F.col("w"), "left").select(
                "node", F.coalesce("p", "component").alias("component")
            ),
            "labels",
        )
        moved = left
        for side in ("u", "v"):
            moved = moved.join(up, F.col(side) == F.col("w"), "left").select(
                *[F.coalesce("p", c).alias(c) if c == side else c for c in ("u", "v")]
            )
        left = written(
            moved.where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct(),
            "edges",
        )
    return labels
