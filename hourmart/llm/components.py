"""Connected components of an undirected graph by lowest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmart.llm.staging import Steps


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """(node, label) for each node of `links` (a, b): label is the lowest node that can be reached.

    Each round takes the lowest label among a node and its neighbours and then the label of that
    label, so long chains shrink quickly. A node with many neighbours is a partial minimum, never
    a gathered list.
    """
    both = steps.keep(
        links.select(F.col("a").alias("node"), F.col("b").alias("next"))
        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("next"))).distinct(), "edges")
    labels = steps.keep(
        both.groupBy("node").agg(F.min("next").alias("low"))
        .select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("next"), F.col("label").alias("reached"))
        low = (both.join(seen, "next").groupBy("node").agg(F.min("reached").alias("low"))
               .join(labels, "node").select("node", "label", F.least("label", "low").alias("low")))
        low = steps.keep(low, "lowest")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("beyond"))
        step = steps.keep(
            low.join(jump, "low").select(
                "node", F.col("beyond").alias("label"), (F.col("beyond") != F.col("label")).alias("changed")), "labels")
        changed = step.filter("changed").limit(1).count()
        steps.drop(low, labels)
        labels = step
        if not changed:
            steps.drop(both)
            return labels.select("node", "label")
