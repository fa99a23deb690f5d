"""Connected components of an edge table, as joins and aggregations per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b`` (long): the smallest node of its component.

    Each round a node takes the smallest label around it and then that label's own label, until
    none changes; a round's labels are a written table. Nothing is gathered per node but a minimum,
    and nodes with many edges are joined, not grouped into one row.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = settle(both, "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = nearer.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), F.col("label").alias("was"))
        after = settle(after, "labels")
        labels = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return labels
