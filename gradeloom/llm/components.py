"""Connected components by label propagation with pointer jumping, in joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import materialise


def components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(id, label): for each id of an edge the smallest id it is connected with.

    Every round a vertex takes the smallest label around it, then that label's own label,
    so rounds grow with the logarithm of the longest path. Labels are written each round.
    """
    a, b = F.col(source).alias("id"), F.col(target).alias("other")
    both = materialise(edges.select(a, b).union(edges.select(F.col(target), F.col(source))).where("id <> other").distinct(), "edges")
    labels = materialise(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = step.join(step.select(F.col("id").alias("to"), F.col("to").alias("far")), "to", "left")
        new = materialise(jump.select("id", F.least(F.coalesce("far", "to"), "to").alias("label"), "was"), "labels")
        if new.where("label <> was").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")
