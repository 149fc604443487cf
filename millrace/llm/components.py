"""Connected components of an edge table, by contraction; nothing but a row count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.stash import stash


def _roots(parent: DataFrame) -> DataFrame:
    """(a, p) with p(a) <= a, followed to its fixed point by doubling."""
    while True:
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = stash(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")))
        if parent.filter("moved").isEmpty():
            return parent.select("a", "p")
        parent = parent.select("a", "p")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node that edges (a, b) reach. Nodes without edges are left out.

    Each round every node hangs itself below its least neighbour, chains of such links are followed to their roots
    by doubling, and edges are renamed to roots; edges inside a tree vanish, so the graph shrinks geometrically.
    """
    edges = edges.select("a", "b").filter("a <> b")
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = stash(both(edges).distinct())
    labels = left.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while not left.isEmpty():
        parent = stash(left.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")))
        root = _roots(parent)
        of = lambda c, to: root.select(F.col("a").alias(c), F.col("p").alias(to))
        labels = stash(labels.join(of("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        left = stash(left.join(of("a", "ra"), "a").join(of("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct())
    return labels
