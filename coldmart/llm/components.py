"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldmart.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; ``root`` is the smallest of its component.

    Every node points to the smallest among itself and its neighbours, and pointers are followed
    until they end at local minima, twice as far each time. Then the links between different
    minima are the next, much smaller table of links. A node with very many neighbours costs
    minima that are taken before the shuffle, and joins that Spark splits.
    """
    edges = _distinct(links)
    labels = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        step = _followed(scratch.table(step.select("node", F.least("node", "least").alias("root")), "step"))
        if labels is None:
            labels = step
        else:
            further = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            labels = scratch.table(
                labels.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root")),
                "labels",
            )
        edges = _distinct(
            edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
        if edges.isEmpty():
            return labels


def _distinct(links: DataFrame) -> DataFrame:
    ordered = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return scratch.table(ordered.distinct(), "edges")


def _followed(step: DataFrame) -> DataFrame:
    """``step`` with every pointer followed to its end."""
    while True:
        beyond = step.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        step = scratch.table(
            step.join(beyond, "root").select(
                "node", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved")
            ),
            "step",
        )
        if step.filter("moved").isEmpty():
            return step.select("node", "root")
        step = step.select("node", "root")
