"""Connected components of a graph of long ids, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b long. (node, component) for every node of a link; component is the smallest id reachable.

    Each round a node takes the smallest label around it, then its label's label; labels are written once a round.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", F.least("component", "m").alias("near"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        now = materialize(nearer.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("component"), "was"), "labels")
        labels = now.select("node", "component")
        if now.where("component <> was").isEmpty():
            return labels
