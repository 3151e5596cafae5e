"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in ``links`` (a, b).

    Each round takes the smallest label among the neighbours and then the label of that label, so
    long chains shrink by halves. Every round is a reliable checkpoint. Both sides of the joins are shuffled
    by Spark, which splits skewed keys; minima are pre-aggregated, so a vertex with many links is no hot group.
    """
    links = links.where("a <> b").select("a", "b")
    links = checkpointed(links.union(links.select("b", "a")).distinct())
    labels = checkpointed(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                          .withColumnRenamed("a", "id"))
    while True:
        near = (
            links.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("next"))
        new = checkpointed(lower.join(jump, "low").select(
            "id", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("label")).alias("moved")))
        done = new.where("moved").isEmpty()
        labels = new.select("id", "label")
        if done:
            return labels.withColumnRenamed("label", "component")
