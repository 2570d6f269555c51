"""Connected components of an edge table, with rounds of joins and a checkpoint per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Each round takes the smallest label among the neighbours and then follows labels once
    (pointer jumping), so a star settles in two rounds and a chain in a logarithmic number.
    Neighbour minima are aggregated map-side, so a node with very many edges does not meet in
    one task. Null ends and self edges are ignored; repeated edges count once.
    """
    clean = (edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
             .where("x is not null and y is not null and x <> y"))
    both = cut(clean.unionByName(clean.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")))
    while True:
        least = (both.join(labels.withColumnRenamed("x", "y"), "y")
                 .groupBy("x").agg(F.min("l").alias("m")))
        hooked = (labels.join(least, "x", "left")
                  .select("x", F.col("l").alias("was"), F.least("l", "m").alias("l")))
        # A label is itself a node, whose own new label may be smaller still.
        jump = hooked.select(F.col("x").alias("l"), F.col("l").alias("ll"))
        step = cut(hooked.join(jump, "l", "left")
                   .select("x", "was", F.least("l", "ll").alias("l")))
        moved = step.where("l <> was").limit(1).count()
        labels = step.select("x", "l")
        if not moved:
            return labels.select(F.col("x").alias("node"), F.col("l").alias("component"))
