"""Edges and ids: speeds, travel times, dense ids, filters, order-preserving mapping, contraction of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.functions import parse_maxspeed
from geosieve.graph import Graph, incident
from geosieve.operators.connectivity import components
from geosieve.plans.ranks import ranked
from geosieve.plans.storage import stored


def edge_speeds(edges: DataFrame) -> DataFrame:
    """Adds speed_kph: the parsed limit, else the mean of the class, else the mean of all.

    Means are aggregated by class and joined back, so no task holds a class.
    """
    e = edges.withColumn("_speed", parse_maxspeed(F.col("maxspeed")))
    means = e.groupBy(F.col("highway").alias("_class")).agg(F.avg("_speed").alias("_mean"))
    everywhere = e.agg(F.avg("_speed").alias("_all"))
    out = e.join(F.broadcast(means), F.col("highway").eqNullSafe(F.col("_class")), "left").crossJoin(F.broadcast(everywhere))
    return out.withColumn("speed_kph", F.coalesce("_speed", "_mean", "_all")).select(*edges.columns, "speed_kph")


def travel_times(edges: DataFrame) -> DataFrame:
    """Adds travel_time in seconds."""
    return edge_speeds(edges).withColumn("travel_time", F.col("length") / 1000 / F.nullif("speed_kph", F.lit(0.0)) * 3600)


def dense_ids(vertices: DataFrame) -> DataFrame:
    """osmid and its place in ascending order, from 0."""
    return ranked(vertices.select("osmid"), ["osmid"], "idx")


def active_nodes(graph: Graph) -> DataFrame:
    """Vertices on an edge."""
    return graph.vertices.join(incident(graph.edges).select("id").distinct(), "id", "left_semi")


def highway_filter(edges: DataFrame, classes: list[str]) -> DataFrame:
    return edges.where(F.col("highway").isin(*classes))


def map_and_dedup(sample: DataFrame, ids: DataFrame) -> DataFrame:
    """(pos, osmid) to (pos, id): unknown ids go, of equal ones the first stays, positions close up."""
    known = sample.join(ids.select("osmid", "id"), "osmid").groupBy("id").agg(F.min("pos").alias("first"))
    return ranked(known, ["first"], "pos").select("pos", "id")


def simplify_chains(graph: Graph) -> DataFrame:
    """Directed edges (eid, src, dst, length, parts, highway if there is one) with pass-through vertices contracted.

    A vertex is passed through if it has exactly two neighbours and either one edge in and one out (one-way), or both with
    each neighbour (two-way). At such a vertex an edge goes on in the one that doesn't lead back; edges that go on in
    each other become one, in each direction: lengths add up, classes are collected in order, eid is the least. Other
    vertices, loops, dead ends, and rings without any other vertex stay as they are.
    """
    tag = ["highway"] if "highway" in graph.edges.columns else []
    e = stored(graph.edges.select("eid", "src", "dst", "length", *tag), "roads")
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    seen = ends.groupBy("id").agg(F.count_distinct("other").alias("n"), F.count(F.lit(1)).alias("d"), F.sum("out").alias("o"), F.count_distinct("other", "out").alias("kinds"), F.max((F.col("other") == F.col("id")).cast("int")).alias("loop"))
    inner = stored(seen.where("n = 2 AND loop = 0 AND ((d = 2 AND o = 1) OR (d = 4 AND kinds = 4))").select("id"), "inner")
    into = e.join(inner, F.col("dst") == F.col("id"), "left_semi").select(F.col("eid").alias("u"), F.col("src").alias("from"), F.col("dst").alias("at"))
    onward = into.join(e.select(F.col("eid").alias("v"), F.col("src").alias("at"), F.col("dst").alias("to")), "at").where("from <> to")
    chain = components(e.select(F.col("eid").alias("id")), onward.select(F.col("u").alias("src"), F.col("v").alias("dst"))).select(F.col("id").alias("eid"), F.col("component").alias("chain"))
    mark = lambda end: inner.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
    rows = e.join(chain, "eid").join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    tags = [F.array_join(F.array_sort(F.collect_set("highway")), ",").alias("highway")] if tag else []
    whole = rows.groupBy("chain").agg(F.min(F.when(F.col("_src").isNull(), F.col("src"))).alias("src"), F.min(F.when(F.col("_dst").isNull(), F.col("dst"))).alias("dst"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("parts"), *tags)
    whole = stored(whole, "chains")
    rings = rows.join(whole.where("src IS NULL").select("chain"), "chain", "left_semi").select("eid", "src", "dst", "length", F.lit(1).cast("long").alias("parts"), *tag)
    return whole.where("src IS NOT NULL").select(F.col("chain").alias("eid"), "src", "dst", "length", "parts", *tag).unionByName(rings)
