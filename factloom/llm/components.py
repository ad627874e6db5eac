"""Connected components over an edge table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Each round every node takes the smallest label among itself and its neighbours and
    then jumps to that label's own label, so long chains halve.  Rounds are staged tables;
    the number of rounds is about the logarithm of the longest shortest path.  A hub with
    very many neighbours only adds rows to partial minima and to joins that adaptive
    execution splits.
    """
    both = stage(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = both.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("to"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        new = stage(step.join(jump.hint("merge"), F.col("to") == F.col("via"), "left").select("node", F.col("label").alias("was"), F.least("to", F.coalesce("further", "to")).alias("label")), "cc-labels")
        changed = new.filter("label < was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
