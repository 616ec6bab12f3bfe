"""Communities: quality, summaries, relabelling, and label propagation with modularity gain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """q of a partition (id, community) over weighted undirected edges (a, b, weight)."""
    e = edges.join(labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    ends = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "weight", F.when(F.col("ca") == F.col("cb"), F.col("weight") / 2).otherwise(0.0).alias("own")), F.struct(F.col("cb").alias("c"), "weight", F.when(F.col("ca") == F.col("cb"), F.col("weight") / 2).otherwise(0.0).alias("own")))).alias("s")).select("s.*")
    by = ends.groupBy("c").agg(F.sum("weight").alias("kc"), F.sum("own").alias("wc"))
    m = edges.agg(F.sum("weight").alias("m"))
    return by.crossJoin(F.broadcast(m)).agg(F.sum(F.col("wc") / F.col("m") - gamma * (F.col("kc") / (2 * F.col("m"))) * (F.col("kc") / (2 * F.col("m")))).alias("q"))


def sizes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("community").agg(F.count(F.lit(1)).alias("size"))


def partition_summary(vertices: DataFrame) -> DataFrame:
    return sizes(vertices).agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("min_size"), F.expr("percentile(size, 0.5)").alias("median_size"), F.max("size").alias("max_size"))


def top_communities(vertices: DataFrame, n: int) -> DataFrame:
    """The vertices with community -1 outside the n largest; ties by the lower label."""
    keep = sizes(vertices.where("community <> -1")).orderBy(F.col("size").desc(), "community").limit(n).select(F.col("community").alias("_keep"))
    return vertices.join(F.broadcast(keep), F.col("community") == F.col("_keep"), "left").withColumn("community", F.coalesce("_keep", F.lit(-1))).drop("_keep")


def size_stats(vertices: DataFrame) -> DataFrame:
    return sizes(vertices).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("size") == 1).cast("double"))).alias("pct_single"), (100 * F.avg((F.col("size") == 2).cast("double"))).alias("pct_pair"))


def smallest(vertices: DataFrame, n: int = 10) -> DataFrame:
    return sizes(vertices).orderBy("size", "community").limit(n)


def kept_share(vertices: DataFrame) -> DataFrame:
    """How many vertices are in a community, and what percentage of all."""
    kept = F.col("community") != -1
    return vertices.agg(F.count(F.when(kept, 1)).alias("n_kept"), (100 * F.avg(kept.cast("double"))).alias("pct_kept"))


def highlight(vertices: DataFrame, k: int, smallest: bool = False, keep_noise: bool = False) -> DataFrame:
    """(id, color): place of the vertex's community among the k largest (or smallest), else -1. -1 takes no part unless keep_noise."""
    by = F.col("size") if smallest else F.col("size").desc()
    top = sizes(vertices if keep_noise else vertices.where("community <> -1")).orderBy(by, "community").limit(k)
    top = top.withColumn("color", F.row_number().over(Window.orderBy(by, "community")) - 1)
    return vertices.join(F.broadcast(top.select("community", "color")), "community", "left").select("id", F.coalesce("color", F.lit(-1)).alias("color"))
