"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component. ``edges`` has a and b.

    Labels move to neighbours and then jump to their label's label, so the rounds grow
    with the logarithm of a component's width. Each round is written to the shared
    folder; only the number of changed labels reaches the driver.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("jump"))
        new = stash(moved.join(target, moved["label"] == target["t"], "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.filter("old <> label").limit(1).count():
            return labels
