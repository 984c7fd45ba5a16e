"""Connected components of a graph that is far too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    Each round takes the smallest label among neighbours and then follows labels once, so
    paths halve. Rounds end when no label changes; each cuts the lineage. Only whether a
    label has changed reaches the driver. Null ends are ignored; loops and repeated edges do no harm.

    The driver's memory follows the number of exchanges that it plans, so a round has as few as
    it can: what neighbours offer and what nodes have go through one aggregation, not a join.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).alias("old"))
        offered = near.unionByName(labels.withColumn("old", F.col("label")))
        hooked = offered.groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label"))
        root = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        moved = cut(hooked.join(root, "label").select("node", "old", F.least("label", "root").alias("label")))
        done = moved.where("old <> label").isEmpty()
        labels = moved.select("node", "label")
        if done:
            return labels
