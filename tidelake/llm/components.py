"""Connected components of an undirected graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import as_table, skew_join


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Every round takes the least label among neighbours, then jumps to the label
    of the label, so that chains shorten by half. Each round is a stored table.
    """
    ways = as_table(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))), f"{label}-edges")
    labels = as_table(ways.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")), label)
    while True:
        seen = skew_join(ways.select("node", F.col("near").alias("at")), labels.select(F.col("node").alias("at"), "component"), ["at"])
        least = seen.groupBy("node").agg(F.min("component").alias("heard"))
        told = labels.join(least, "node", "left").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("now"))
        told = as_table(told, f"{label}-told")
        jump = skew_join(told.withColumn("at", F.col("now")), told.select(F.col("node").alias("at"), F.col("now").alias("further")), ["at"], "left")
        after = as_table(jump.select("node", "before", F.least("now", "further").alias("component")), label)
        labels = after.select("node", "component")
        if after.where("component < before").isEmpty():
            return labels
