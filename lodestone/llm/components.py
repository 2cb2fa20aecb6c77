"""Connected components of a link table by contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage


def component_labels(links: DataFrame) -> DataFrame:
    """node, label for every end of links (a, b); label is the same for all nodes of a component.

    Each round every node points at its smallest neighbour (or itself), pointers are followed to their end,
    which doubles their reach each time, and links are renamed to the nodes at the end. These are smaller
    than all their neighbours, so at most half the nodes still have links; rounds, and the steps of each,
    grow with the logarithm of the nodes. Tables are written to the shared folder between steps.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    labels = stage(ends.select("node", F.col("node").alias("label")), "cc-labels")
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        point = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "cc-point")
        moving = True
        while moving:
            onward = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            moved = stage(point.select("node", "to").join(onward, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "cc-point")
            point, moving = moved.select("node", "to"), not moved.where("moved").isEmpty()
        a_to = point.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        b_to = point.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        renamed = links.join(a_to, "a").join(b_to, "b").where("a2 <> b2")
        links = stage(renamed.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "cc-links")
        moved = point.select(F.col("node").alias("label"), F.col("to").alias("next"))
        labels = stage(labels.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "cc-labels")
    return labels
