"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, class: the least node of its component) of all nodes in edges (a, b), of any type that can be ordered.

    In each round a node takes the least class among its neighbours', and then its class's own class, so the classes of a long chain
    double their reach; a table is written each round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        step = labels.join(near, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("next"))
        new = stored(step.join(jump, "class", "left").select("node", "old", F.least("class", "next").alias("class")))
        labels = new.select("node", "class")
        if not new.where(F.col("old") != F.col("class")).limit(1).count():
            return labels
