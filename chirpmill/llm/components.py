"""Connected components of a graph given as links, by the least label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpmill.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of all nodes that ``links`` (``a, b``) name; the component is its least node.

    Every round takes the least label among a node and its neighbours and then that label's own label, and is
    written, so a lost executor costs one round. A node with very many links is one partial minimum per task.
    """
    links = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                   .select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        said = (
            edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("other").alias("least"))
        )
        low = labels.join(said, "node").select("node", "component", F.least("component", "least").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("above"))
        step = stage(
            low.join(up, "low", "left").select(
                "node", F.least("low", "above").alias("component"),
                (F.least("low", "above") < F.col("component")).alias("moved")), "labels")
        labels = step.drop("moved")
        if step.where("moved").isEmpty():
            return labels
