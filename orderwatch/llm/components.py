"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge; a component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so paths shrink by half or better. Rounds are written to the shared
    folder. Columns ``a`` and ``b`` are ids; loops and repeated edges do no harm.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stored(both.union(both.select("other", "node")).filter("node != other").distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        better = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        target = labels.select(F.col("node").alias("to"), F.col("component").alias("end"))
        better = stored(better.join(target, "to").select("node", "was", F.least("to", "end").alias("component")), "labels")
        done = not better.filter("was != component").limit(1).count()
        labels = better.select("node", "component")
        if done:
            return labels
