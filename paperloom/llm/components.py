"""Connected components by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.workspace import Workspace


def connected_components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of edges(a, b); label is the smallest node it reaches.

    Each round takes the smallest label among the neighbours and then the label
    of the label, so a path of n links needs about log n rounds. Every round is
    a table of its own; nothing is gathered on the driver but a count. An edge
    from a node to itself says nothing; without edges the result is empty.
    """
    both = ws.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}_links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    step = 0
    while True:
        step += 1
        moved = ws.save(_round(both, labels), f"{name}_{step}")
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        ws.drop(f"{name}_{step - 1}")
        if not changed:
            ws.drop(f"{name}_links")
            return labels


def _round(both: DataFrame, labels: DataFrame) -> DataFrame:
    near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
    moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
    jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
    return moved.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
