"""Connected components of an edge table by contraction, as joins with a written table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b); the component is the smallest node that is reachable.

    Each round lets every node point to its smallest neighbour if that is smaller, follows the pointers to their ends by
    doubling, and replaces the edges' ends by what they point to. Edges within a component vanish, so the rounds end
    after about the logarithm of the longest path. Null ends and loops are no edges; without edges there are no rows.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = written(edges, "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = written(nodes.withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        pointers = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        pointers = written(pointers, "pointers")
        while True:
            ends = pointers.select(F.col("node").alias("to"), F.col("to").alias("further"))
            doubled = pointers.join(ends, "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
            doubled = written(doubled, "pointers")
            pointers = doubled.drop("moved")
            if doubled.where("moved").isEmpty():
                break
        labels = _followed(labels, pointers, "component")
        labels = written(labels, "labels")
        edges = _followed(_followed(edges, pointers, "a"), pointers, "b")
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        edges = written(edges, "edges")
    return labels


def _followed(rows: DataFrame, pointers: DataFrame, column: str) -> DataFrame:
    to = pointers.select(F.col("node").alias(column), F.col("to").alias("_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
