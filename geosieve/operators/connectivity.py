"""Components, representatives, spanning trees and virtual edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.functions import euclid
from geosieve.graph import Graph
from geosieve.operators.plane import neighbours
from geosieve.plans.ranks import ranked
from geosieve.plans.storage import stored

#: Detour of a virtual edge, what a link between trees costs more, and metres a degree (fixed values).
PENALTY, RESCUE, DEGREE = 1.5, 2.0, 111_000.0


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its least id) of every vertex, over edges in both directions.

    Large-star and small-star rounds: their number grows with the logarithm of the size, not with the diameter.
    """
    pairs = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "components")
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = stored(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct(), "components")
        same = star.exceptAll(pairs).limit(1).count() == 0 and pairs.exceptAll(star).limit(1).count() == 0
        pairs = star
        if same:
            break
    return vertices.select("id").join(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def representatives(vertices: DataFrame, group: str = "component") -> DataFrame:
    """Of each group the vertex nearest to its centroid, ties by id."""
    mean = vertices.groupBy(group).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    best = vertices.join(mean, group).groupBy(group).agg(F.min(F.struct(F.round(euclid("x", "y", "mx", "my"), 12).alias("d"), F.col("id"), F.col("x"), F.col("y"))).alias("r"))
    return best.select(group, "r.id", "r.x", "r.y")


def nearest_in_plane(points: DataFrame, k: int) -> DataFrame:
    """(a, b, d): the k nearest other points (id, x, y) of each, ties by id; all others where there are fewer."""
    return neighbours(points, k).select("a", "b", "d")


def kth_distance(points: DataFrame, k: int = 10) -> DataFrame:
    """(id, d): the distance to the k-th nearest of the points (id, x, y), each counting as its own first."""
    return nearest_in_plane(points, k - 1).groupBy(F.col("a").alias("id")).agg(F.max("d").alias("d"))


def nearest_representatives(reps: DataFrame, k: int = 10, scale: float = 1.0, penalty: float = PENALTY) -> DataFrame:
    """(a, b, weight) to the k - 1 nearest other representatives (k counts the point itself)."""
    return nearest_in_plane(reps, k - 1).select("a", "b", (F.col("d") * scale * penalty).alias("weight"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Boruvka: (a, b, weight) of a minimum spanning forest; ties by (weight, a, b). Rounds grow with the logarithm."""
    e = stored(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("weight").alias("weight")), "boruvka")
    nodes = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    label, tree = stored(nodes.withColumn("component", F.col("id")), "boruvka"), None
    while True:
        at = e.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").where("ca <> cb")
        ends = at.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("weight", "a", "b").alias("e"))
        best = stored(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "boruvka")
        if best.limit(1).count() == 0:
            return tree if tree is not None else best.select("a", "b", "weight")
        tree = stored((best if tree is None else tree.unionByName(best)).select("a", "b", "weight"), "boruvka")
        label = stored(components(nodes, tree.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "boruvka")


def bridge_chain(reps: DataFrame, scale: float = 1.0, penalty: float = PENALTY * RESCUE) -> DataFrame:
    """Each representative linked to the one before it by id."""
    at = stored(ranked(reps.select("id", "x", "y"), ["id"], "_place"), "chain")
    before = at.select(F.col("id").alias("a"), F.col("x").alias("px"), F.col("y").alias("py"), (F.col("_place") + 1).alias("_place"))
    rows = at.join(before, "_place")
    return rows.select("a", F.col("id").alias("b"), (euclid("x", "y", "px", "py") * scale * penalty).alias("weight"))


def placed(vertices: DataFrame) -> tuple[DataFrame, float] | None:
    """Vertices with x and y, and metres a unit: those of x, y as they are, else lon, lat in degrees; None without either."""
    if {"x", "y"} <= set(vertices.columns):
        return vertices, 1.0
    if {"lon", "lat"} <= set(vertices.columns):
        return vertices.withColumn("x", F.col("lon")).withColumn("y", F.col("lat")), DEGREE
    return None


def connect(graph: Graph, k: int = 10, scale: float | None = None, chain_above: int = 5000) -> DataFrame:
    """Virtual edges (src, dst, length, type) that make the graph connected; none if it is, or if vertices have no place.

    Each component's representative is linked to its nearest ones and the least spanning forest taken; what is still apart
    is linked, at a higher price, by a spanning tree over the first representatives of the trees, or above
    `chain_above` trees by a chain.
    """
    spark = graph.vertices.sparkSession
    none = spark.createDataFrame([], "src long, dst long, length double, type string")
    parts = stored(components(graph.vertices, graph.edges), "parts")
    at = placed(graph.vertices)
    if at is None or parts.select("component").distinct().limit(2).count() < 2:
        return none
    vertices, metres = at
    metres = metres if scale is None else scale
    reps = stored(representatives(vertices.join(parts, "id")), "reps")
    tree = spanning_forest(nearest_representatives(reps, k, metres))
    trees = stored(components(reps, tree.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "trees")
    count = trees.select("component").distinct().count()
    if count > 1:
        firsts = reps.join(trees.groupBy(F.col("component").alias("_c")).agg(F.min("id").alias("id")), "id")
        if count > chain_above:
            tree = tree.unionByName(bridge_chain(firsts, metres))
        else:  # at most chain_above points
            a, b = firsts.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), firsts.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
            meta = a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (euclid("ax", "ay", "bx", "by") * metres * PENALTY * RESCUE).alias("weight"))
            tree = tree.unionByName(spanning_forest(meta))
    return tree.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").alias("length"), F.lit("virtual").alias("type"))


def connected(graph: Graph, k: int = 10, weight: str = "length") -> Graph:
    """The graph with its virtual edges appended: their weight in the column `weight`, type 'virtual'.

    Without that column all edges that were there get 1.0. New eids follow the largest.
    """
    extra = connect(graph, k).withColumnRenamed("length", weight)
    edges = graph.edges if weight in graph.edges.columns else graph.edges.withColumn(weight, F.lit(1.0))
    if "eid" in edges.columns:
        top = edges.agg(F.max("eid")).first()[0]
        extra = ranked(extra, ["src", "dst"], "eid").withColumn("eid", F.col("eid") + F.lit(0 if top is None else top + 1))
    return Graph(graph.vertices, edges.unionByName(extra, allowMissingColumns=True))
