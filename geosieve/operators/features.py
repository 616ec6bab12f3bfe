"""Node features from incident edges, all in one pass over both ends of every edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosieve.functions import parse_maxspeed
from geosieve.graph import Graph, incident, symmetric

#: Road classes with a frequency of their own; every other one, and none, is `other` (fixed values).
MAIN = ("residential", "primary", "motorway", "service")


def _class() -> Column:
    return F.when(F.col("highway").isin(*MAIN), F.col("highway")).otherwise("other")


def tag_features(graph: Graph) -> DataFrame:
    """id, freq_<class>, avg_maxspeed, degree, avg_edge_len_all of every vertex; 0 where nothing is incident."""
    graph.validate(edge=("src", "dst", "highway", "maxspeed", "length"))
    shares = [F.avg((_class() == c).cast("double")).alias(f"freq_{c}") for c in (*MAIN, "other")]
    got = incident(graph.edges).groupBy("id").agg(*shares, F.avg(parse_maxspeed(F.col("maxspeed"))).alias("avg_maxspeed"), F.count(F.lit(1)).alias("degree"), F.avg("length").alias("avg_edge_len_all"))
    return graph.vertices.select("id").join(got, "id", "left").fillna(0)


def average_edge_length(graph: Graph, mode: str = "out") -> DataFrame:
    """id, avg_edge_len over outgoing edges, or over both ends with mode 'all'."""
    rows = graph.edges.select(F.col("src").alias("id"), "length") if mode == "out" else incident(graph.edges).select("id", "length")
    got = rows.groupBy("id").agg(F.avg("length").alias("avg_edge_len"))
    return graph.vertices.select("id").join(got, "id", "left").fillna(0.0)


def clustering(graph: Graph) -> DataFrame:
    """id, clustering_coeff: links among the distinct neighbours by all pairs of them; 0 below two neighbours.

    Edges point from the end of lower degree, so no vertex has more than about sqrt(2 m) outgoing ones, whatever its degree.
    """
    both = symmetric(graph.edges).select("src", "dst")
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    ranked = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    up = ranked.where("d < e OR (d = e AND src < dst)").select("src", "dst")
    wedge = up.alias("p").join(up.alias("q"), (F.col("p.src") == F.col("q.src")) & (F.col("p.dst") != F.col("q.dst"))).select(F.col("p.src").alias("a"), F.col("p.dst").alias("b"), F.col("q.dst").alias("c"))
    closed = wedge.join(up, (F.col("b") == up["src"]) & (F.col("c") == up["dst"])).select(F.explode(F.array("a", "b", "c")).alias("id"))
    triangles = closed.groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    got = degree.withColumnRenamed("src", "id").join(triangles, "id", "left").select("id", F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering_coeff"))
    return graph.vertices.select("id").join(got, "id", "left").fillna(0.0)


def node_features(graph: Graph, mode: str = "out") -> DataFrame:
    """All features, one row a vertex."""
    return tag_features(graph).drop("avg_edge_len_all").join(average_edge_length(graph, mode), "id").join(clustering(graph), "id")


def tag_frequency_pivot(graph: Graph) -> DataFrame:
    """The same frequencies by pivot, of vertices with edges."""
    wide = incident(graph.edges).select("id", _class().alias("c")).groupBy("id").pivot("c", [*MAIN, "other"]).count().fillna(0)
    total = sum((F.col(c) for c in (*MAIN, "other")), F.lit(0))
    return wide.select("id", *((F.col(c) / total).alias(f"freq_{c}") for c in (*MAIN, "other")))
