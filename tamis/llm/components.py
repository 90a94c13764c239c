"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``; the label is the component's smallest node.

    Every round takes the smallest label beside a node and then the label of that label, so that the
    rounds grow with the logarithm of the longest way. Groups are only ever reduced to a minimum.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).where("node is not null and other is not null")
    both = staged(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))), "links")
    labels = both.groupBy("node").agg(F.min("other").alias("label"))
    labels = staged(labels.select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        other = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        near = both.join(other, "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # The label of the label; labels are nodes, so it is found.
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        lower = lower.join(above, "label").select("node", F.least("label", "above").alias("label"), "was")
        lower = staged(lower.select("node", "label", (F.col("label") != F.col("was")).alias("moved")), "labels")
        labels = lower.select("node", "label")
        if lower.where("moved").isEmpty():
            return labels
