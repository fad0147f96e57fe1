"""Connected components as DataFrame joins, with lineage cut after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node reachable from each node that has an edge.

    Every round each node takes the smallest label among itself, its neighbours and its label's own label, so long
    chains halve; the minimum is a partial aggregate, so a node with very many edges is no hot key.
    """
    both = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("near")).union(
        edges.select(F.col(b).alias("node"), F.col(a).alias("near"))).distinct())
    labels = stored(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("comp")))
    while True:
        heard = (both.join(labels.select(F.col("node").alias("near"), F.col("comp").alias("heard")), "near")
                 .groupBy("node").agg(F.min("heard").alias("heard")))
        best = labels.join(heard, "node").select("node", "comp", F.least("comp", "heard").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("comp").alias("over"))
        fresh = stored(best.join(jump, "best").select("node", F.col("comp").alias("old"), F.least("best", "over").alias("comp")))
        labels = fresh.select("node", "comp")
        if fresh.filter("old <> comp").isEmpty():
            return labels
