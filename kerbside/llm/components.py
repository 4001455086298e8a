"""Connected components of a graph given by its edges, as Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import stored


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node it is
    connected with.

    Each round takes the least label among neighbours and then the label's own
    label, so that paths shorten by more than one step a round; it ends with the
    first round that changes nothing. Rounds are cut by tables in ``folder``.
    Loops and repeated edges do no harm; without edges there is no node.
    """
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    links = stored(both.filter("a != b").distinct(), folder, "links")
    labels = stored(
        links.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("a"), F.min("b")).alias("label")
        ),
        folder, "labels-0",
    )
    turn = 0
    while True:
        turn += 1
        told = links.join(labels.withColumnRenamed("node", "b"), "b")
        best = told.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = best.join(labels, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stored(
            nearer.join(jump, "label", "left").select(
                "node", "old", F.least("label", "further").alias("label")
            ),
            folder, f"labels-{turn}",
        )
        labels = moved.select("node", "label")
        if moved.filter("old != label").isEmpty():
            return labels
