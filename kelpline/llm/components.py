"""Connected components by labels that only fall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import stored


BROADCAST_ROWS = 200_000


def connected_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after joining the components that links (a, b) connect; the least label stands for each.

    Works on the graph of labels: each takes the least label next to it, then the label of that label, until none falls.
    A label with very many links costs no more than its links: both steps are joins and minima.
    """
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("p")), "a")
    ends = ends.join(labels.select(F.col("node").alias("b"), F.col("label").alias("q")), "b").where("p <> q")
    edges = ends.select("p", "q").union(ends.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    edges = stored(edges, "component-edges")
    if edges.isEmpty():
        return labels
    at = edges.groupBy("p").agg(F.min("q").alias("q")).select(F.col("p").alias("v"), F.least("p", "q").alias("r"))
    at = stored(at, "component-roots")
    # The labels of a step are counted: a few are broadcast, more are joined by shuffle.
    small = (lambda df: F.broadcast(df)) if at.count() <= BROADCAST_ROWS else (lambda df: df)
    while True:
        near = edges.join(small(at.select(F.col("v").alias("q"), F.col("r").alias("s"))), "q").select(F.col("p").alias("v"), "s", F.lit(None).cast("binary").alias("old"))
        own = at.select("v", F.col("r").alias("s"), F.col("r").alias("old"))
        fell = near.union(own).groupBy("v").agg(F.min("s").alias("t"), F.max("old").alias("old"))
        jump = small(at.select(F.col("v").alias("t"), F.col("r").alias("far")))
        new = stored(fell.join(jump, "t", "left").select("v", F.least("t", F.coalesce("far", "t")).alias("r"), "old"), "component-roots")
        at = new.select("v", "r")
        if new.where("r <> old").isEmpty():
            break
    at = at.select(F.col("v").alias("label"), "r")
    return stored(labels.join(at, "label", "left").select("node", F.coalesce("r", "label").alias("label")), "component-labels")
