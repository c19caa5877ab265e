"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintline.session import settle


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``links`` (``a``, ``b``); a label is the component's smallest node.

    Every round a node takes the smallest label among itself and its neighbours, then the label that its
    label's node has; rounds go on until nothing changes. Labels are written out each round, so no round
    repeats the ones before it. A node with very many neighbours costs one row per task, as
    minima are taken before the shuffle. Labels meet in merge joins, so none of them pass through the driver.
    """
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b")
            .select(F.col("a").alias("node"), "label")
            .unionByName(labels)
            .groupBy("node")
            .agg(F.min("label").alias("label"))
        )
        heads = labels.select(F.col("node").alias("label"), F.col("label").alias("head"))
        # a label is a node, so each has a head
        new = settle(near.join(heads.hint("merge"), "label").select("node", F.least("label", "head").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "old").hint("merge"), "node").filter("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
