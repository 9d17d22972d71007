"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survlake.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): the label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so paths halve; it ends with the first round that changes nothing.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m")))
        step = labels.join(near, labels["node"] == near["n"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("u"), F.col("label").alias("top"))
        new = stored(step.join(up, F.col("label") == F.col("u")).select("node", F.least("label", "top").alias("label"), "old"))
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
