"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.llm.runtime import stored


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for the ends of the
    links (a, b).

    Each round gives a node the least label among its neighbours and itself,
    then the label of that label; stops when nothing changes.  Rounds grow with
    the logarithm of a component's breadth for the most part, and minima are
    taken map-side, so a node with many links is no burden."""
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                   "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (edges.join(labels, edges["b"] == labels["node"]).groupBy(edges["a"].alias("n"))
                .agg(F.min("label").alias("near")))
        step = stored(labels.join(near, F.col("node") == F.col("n")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "step")
        jump = step.select(F.col("node").alias("j"), F.col("label").alias("further"))
        fresh = stored(step.join(jump, F.col("label") == F.col("j")).select(
            "node", "old", F.least("label", "further").alias("label")), "labels")
        changed = not fresh.where("old <> label").isEmpty()
        labels = fresh.select("node", "label")
        if not changed:
            return labels
