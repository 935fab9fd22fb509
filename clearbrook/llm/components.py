"""Connected components of a table of links, as repeated joins; nothing of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so a path's
    length is at least halved; rounds end when no label changes."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        step = lower.join(labels.select(F.col("node").alias("n"), F.col("label").alias("jump")), F.col("low") == F.col("n"), "left")
        made = written(step.select("node", "old", F.least("low", "jump").alias("label")), "labels")
        changed = made.filter("label <> old").limit(1).count()
        forget(labels)
        labels = made.select("node", "label")
        if not changed:
            forget(both)
            return labels
