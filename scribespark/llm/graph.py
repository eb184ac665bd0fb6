"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribespark.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """key, comp (the least key of its component) of every key in ``links`` (a, b).

    Each round takes the least label among neighbours, then the label's label; a path of n links ends
    in about log n rounds.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "key"), "labels")
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "key"), "key").select("key", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        jump = labels.select(F.col("key").alias("next"), F.col("comp").alias("beyond"))
        moved = written(least.join(jump, "next", "left").select("key", F.least("next", F.coalesce("beyond", "next")).alias("comp"), "old"), "labels")
        labels = moved.drop("old")
        if not moved.where("comp <> old").limit(1).count():
            return labels
