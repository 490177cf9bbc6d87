"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumloom.llm.common import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every end of an edge ``(a, b)``; the component is named by its smallest id.

    Each round a vertex takes the smallest label of its neighbours, then the label of that label, so a chain
    of n vertices needs about log n rounds. Labels are combined before each shuffle, hence a vertex with
    very many edges costs one row per task; each round is cut to the shared folder. Nothing but the number
    of changed labels reaches the driver.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id")
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        lower = stage(
            labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        up = lower.select(F.col("id").alias("label"), F.col("label").alias("top"))
        jumped = stage(lower.join(up, "label").select("id", "old", F.least("label", "top").alias("label")))
        changed = jumped.where(F.col("old") != F.col("label")).limit(1).count()
        labels = jumped.select("id", "label")
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
