"""Connected components by contraction; joins and minima only, so that a hub's links never meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.common import forget, written


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids, any order, repeats and loops allowed -> (v, label): label is the least id of v's component.

    Each round every vertex takes its least neighbour as parent, parents are followed twice, and the edges are
    relabelled; what is left is written in the shared folder. Only the number of rounds comes to the driver.
    """
    edges = written(_ordered(edges), "edges")
    labels = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("label", F.col("v"))
    old: list[DataFrame] = []
    while not edges.isEmpty():
        parents = written(edges.groupBy("a").agg(F.min("b").alias("p")), "parents")
        for _ in range(2):
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parents = parents.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        step = written(parents, "steps")
        new = labels.join(step.withColumnRenamed("a", "label"), "label", "left").select("v", F.coalesce("p", "label").alias("label"))
        labels = written(new, "labels")
        first = step.select("a", F.col("p").alias("pa"))
        second = step.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(first, "a", "left").join(second, "b", "left")
        rest = written(_ordered(moved.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))), "edges")
        old += [edges, step]
        edges = rest
    forget(*old)
    return labels
