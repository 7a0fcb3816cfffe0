"""Connected components over an edge table that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(a, b) long links -> (node, label), label the smallest node reachable; nodes without links are not returned.

    Each round takes the least label among a node's neighbours and then that label's own label (pointer jumping), so
    chains halve. A hub's rows are combined map-side by the min(); joins have one row per key on one side. Every round
    is written to the shared folder; the driver sees one count.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e = e.union(e.select("b", "a"))
    e = ws.keep(e, "links")
    both = e.union(e.select("a", F.col("a").alias("b")).distinct())
    labels = ws.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        near = ws.keep(near, "near")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nxt = near.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        nxt = ws.keep(nxt, "labels")
        changed = nxt.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        ws.drop(labels, near)
        labels = nxt
        if not changed:
            ws.drop(e)
            return labels
