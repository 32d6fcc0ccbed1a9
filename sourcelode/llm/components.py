"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.store import settled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each node to the least of them; ``large``: only those above the node."""
    down = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = down.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = both if large else both.where("other < node")
    least = near.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    ties = near.join(least, "node")
    ties = ties.where("other > node") if large else ties
    pairs = ties.select(F.col("other").alias("b"), F.col("least").alias("a"))
    if not large:
        pairs = pairs.unionByName(least.select(F.col("node").alias("b"), F.col("least").alias("a")))
    return pairs.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node that has an edge, and the least node it can reach.

    ``edges`` has columns a and b of one ordered type; direction, repeats and loops don't matter.
    Alternating large-star and small-star steps shrink every component to a star around its least
    node in about log rounds. Each step is written to shared storage.
    """
    current = settled(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    while True:
        current = settled(_star(_star(current, True), False), "edges")
        size = current.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("b").alias("leaves")).first()
        inner = current.select("a").join(current.select(F.col("b").alias("a")), "a", "left_semi")
        if size["edges"] == size["leaves"] and inner.isEmpty():
            break
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
