"""Connected components of a graph given as edges, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, hot_join


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b).

    Every round a node takes the smallest label among its neighbours (a partial aggregate), then the label
    of its label; labels are written to the shared folder after every round, which cuts the lineage, and those of
    the round before are deleted. Paths of labels halve every round, so rounds grow with the logarithm of a component's
    diameter. The edges of nodes with very many neighbours meet their node's label by broadcast.
    """
    ws = Workspace(edges.sparkSession, "components")
    plain = edges.filter("a <> b")
    both = ws.table(plain.select("a", "b").union(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = ws.table(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select("node", F.least("node", "m").alias("label"), "degree"),
        "labels",
    )
    for _ in range(max_rounds):
        near = hot_join(both, labels.select(F.col("node").alias("b"), "label", "degree"), "b", "degree")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"), "degree")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = closer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"), "degree")
        moved = ws.table(moved, "labels")
        ws.drop_others(both, moved)
        if moved.filter("label <> old").limit(1).count() == 0:
            ws.drop(both)
            return moved.select("node", "label")
        labels = moved
    raise RuntimeError("labels did not settle")
