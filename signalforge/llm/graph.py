"""Connected components by contraction: labels are tables, nothing of the graph comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, materialise


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): each node with the smallest node reachable, from nodes (node) and undirected edges (a, b).

    Every round points each component at its smallest neighbour, shortens the pointers and contracts the edges;
    the number of components that still have edges falls at least by half a round.
    """
    labels = None
    edges = materialise(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp"))
        parent = materialise(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
            parent = materialise(attach(parent, up, ["comp"], "node").select("node", F.coalesce("upper", "comp").alias("comp")), "parents")
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
            labels = materialise(attach(labels, up, ["comp"], "node").select("node", F.coalesce("upper", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            up = parent.select(F.col("node").alias(end), F.col("comp").alias("_up"))
            edges = attach(edges, up, [end], other).select(F.coalesce("_up", end).alias(end), other)
        edges = materialise(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    if labels is None:
        return nodes.select("node", F.col("node").alias("comp"))
    return attach(nodes.select("node"), labels, ["node"], "node").select("node", F.coalesce("comp", "node").alias("comp"))
