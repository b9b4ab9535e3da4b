"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; the component is
    the smallest node that can be reached.

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so a path of n nodes takes about log n rounds and a
    star two.  Labels are written to the shared folder after each round; the
    driver only learns whether any changed.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")),
                   "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = (labels.join(near, "node")
                .select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid")))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = saved(step.join(jump, "mid", "left")
                    .select("node", F.least("mid", F.coalesce("far", "mid")).alias("component"), "old"), "labels")
        changed = not new.where("component <> old").isEmpty()
        labels = new.select("node", "component")
        if not changed:
            return labels
