"""Connected components of a large graph given as edges, by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: of every node that has an edge, the least node of its component.

    Each round takes the least label of a node's neighbours and then the label of
    that label, so long chains shorten by doubling; stars around their least node
    take one round.  Joins and minima only: no group of neighbours is ever
    gathered.  Rounds end when no label changes.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        step = cut(labels.join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        if not step.where("old != label").limit(1).count():
            return step.select("node", "label")
        # Both sides are read from the checkpoint, so that Spark can split a label that many nodes have.
        beyond = step.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        labels = cut(step.join(beyond, F.col("label") == F.col("via")).select("node", F.least("label", "beyond").alias("label")))
