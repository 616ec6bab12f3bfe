"""A graph is two DataFrames: vertices (id, ...) and edges (eid, src, dst, length, ...). Ids are stable and never renumbered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def validate(self, vertex: tuple = ("id",), edge: tuple = ("src", "dst")) -> "Graph":
        """Raises if a column that an operator needs is missing."""
        for frame, names, kind in ((self.vertices, vertex, "vertex"), (self.edges, edge, "edge")):
            if gone := [c for c in names if c not in frame.columns]:
                raise ValueError(f"missing {kind} column: {', '.join(gone)}")
        return self


def incident(edges: DataFrame) -> DataFrame:
    """A row for each end of each edge: id, other, and the edge's columns. A loop counts at both of its ends."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    return edges.withColumn("_end", F.explode(ends)).select("_end.*", *edges.columns)


def undirected_min(edges: DataFrame) -> DataFrame:
    """Parallel and reverse edges become one with the least length; loops stay."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("length").alias("length"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, length) in both directions, for traversal."""
    one = undirected_min(edges).where("a <> b")
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "length").union(one.select("b", "a", "length"))


def induced(graph: Graph, keep: DataFrame) -> Graph:
    """The subgraph on the ids of `keep`."""
    ids = keep.select(F.col("id").alias("_keep")).distinct()
    e = graph.edges.join(ids, F.col("src") == F.col("_keep"), "left_semi").join(ids, F.col("dst") == F.col("_keep"), "left_semi")
    return Graph(graph.vertices.join(ids, F.col("id") == F.col("_keep"), "left_semi"), e)
