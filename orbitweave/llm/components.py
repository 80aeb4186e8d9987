"""Connected components of links between ids, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connect(links: DataFrame) -> DataFrame:
    """(v, label) for every id in ``links`` (columns a, b): the smallest id that it reaches.

    Each pass takes the least label among neighbours, then the label's own label;
    tables in the shared folder cut the lineage between passes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(both, "edges")
    labels = materialize(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.v == near.a).select("v", "label", F.least("label", "near").alias("next"))
        moved = materialize(moved, "moved")
        target = moved.select(F.col("v").alias("next"), F.col("next").alias("jump"))
        after = materialize(
            moved.join(target, "next", "left").select(
                "v", F.least("next", F.coalesce("jump", "next")).alias("label"), F.col("label").alias("was")
            ),
            "labels",
        )
        labels = after.select("v", "label")
        if after.where("label <> was").isEmpty():
            return labels
