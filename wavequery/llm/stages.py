"""Stages that are read more than once, and connected components over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequery.session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest reachable node) of every node in ``links(a, b)``.

    Each round, a node takes the smallest label among its neighbours, then the label of its label, so
    labels travel twice as far per round. Rounds are written, and only their number of changes reaches
    the driver.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct()
    both = written(both, "links")
    lowest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_near"))
    labels = written(lowest.select("node", F.least("node", "_near").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        best = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        lower = labels.join(best, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new")
        )
        jump = labels.select(F.col("node").alias("_new"), F.col("component").alias("_beyond"))
        moved = lower.join(jump, "_new", "left").select(
            "node", "_old", F.least("_new", F.coalesce("_beyond", "_new")).alias("component")
        )
        moved = written(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where("component != _old").isEmpty():
            return labels
