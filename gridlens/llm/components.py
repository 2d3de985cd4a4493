"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Tables


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, label) of all nodes of the links (a, b); the label is the component's least node.

    Each round a node takes the least label among its neighbours' and then its label's
    label, so labels run over paths that double in length.  A hot node is only a hot key
    of joins, which are split, and of minima, which are taken partially first."""
    both = tables.store(links.select(F.col("a").alias("s"), F.col("b").alias("t")).unionByName(links.select(F.col("b").alias("s"), F.col("a").alias("t"))).distinct())
    labels = tables.store(both.groupBy("s").agg(F.min("t").alias("t")).select(F.col("s").alias("node"), F.least("s", "t").alias("label")))
    while True:
        near = both.join(labels, both["t"] == labels["node"]).groupBy("s").agg(F.min("label").alias("least"))
        moved = labels.join(near, labels["node"] == near["s"]).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        far = moved.join(jump, F.col("label") == F.col("via")).select("node", "old", F.least("label", "far").alias("label"))
        labels = tables.store(far)
        if not labels.where(F.col("old") != F.col("label")).limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
