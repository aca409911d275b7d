"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of each node that a link ``a, b`` names; a component is its smallest node.

    Each round a node takes the smallest label among its neighbours' and then the label of its label,
    so chains halve from round to round; the rounds end when no label changes.  Tables are written
    between rounds: a lost executor costs one round, and both sides of each join are shuffled for it,
    so that a node with very many links is split.  Links with a null end and self links name no node.
    """
    ends = links.select("a", "b").where("a != b")
    both = stored(ends.union(ends.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("component")
    ))
    while True:
        nearest = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("nearest"))
        )
        moved = stored(
            labels.join(nearest, "node").select(
                "node", F.least("component", "nearest").alias("component"), F.col("component").alias("before")
            )
        )
        further = moved.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = stored(
            moved.join(further, "component", "left").select(
                "node", F.coalesce("further", "component").alias("component"), "before"
            )
        )
        changed = labels.where("component < before").limit(1).count()
        labels = labels.drop("before")
        if not changed:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (node, component)`` after more links.  Only links between different components count,
    and as one link of the two components, so earlier links are not read again."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias("of"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    step = components(ends.distinct())
    moved = step.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(old.unionByName(step.join(labels.select("node"), "node", "left_anti")))
