"""Samples of k vertices as (pos, id). Randomness is the md5 of seed and id, equal in any partitioning and in plain SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.functions import draw
from geosieve.graph import Graph
from geosieve.operators.distances import SMALL_EDGES, Blocks, small_net
from geosieve.plans.storage import forget, stored


def uniform(vertices: DataFrame, k: int, seed: int) -> DataFrame:
    """min(k, n) vertices without replacement. Only the k least keys of each partition are ordered."""
    best = vertices.select("id", draw(seed, F.col("id")).alias("key")).orderBy("key", "id").limit(k)
    return best.select((F.row_number().over(Window.orderBy("key", "id")) - 1).alias("pos"), "id")


def community_representatives(vertices: DataFrame, degree: DataFrame) -> DataFrame:
    """Of each community the vertex of largest degree, ties by id; -1 is none."""
    best = vertices.where("community <> -1").join(degree, "id").groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("id"))).alias("r"))
    return best.select("community", "r.id", (-F.col("r.d")).alias("degree"))


def round_robin(vertices: DataFrame, k: int, seed: int, order: DataFrame | None = None, reshuffle_on_reset: bool = True, keep_noise: bool = False) -> DataFrame:
    """One vertex of each community a pass, without replacement; when all are used up, a new cycle.

    A new cycle has new draws, or with reshuffle_on_reset=False those of the first. Communities stand in the drawn order,
    or in that of `order` (community, city_pos); then only its communities count. -1 is no community unless keep_noise.
    The r-th vertex of the p-th community in a cycle has the key (cycle, r, p), so no loop is needed. No community gives
    more than k in a cycle, so those are cut before the final order.
    """
    pool = vertices.select("id", "community") if keep_noise else vertices.where("community <> -1").select("id", "community")
    if order is not None:
        pool = pool.join(order, "community")
    total = pool.count()
    if total == 0 or k <= 0:
        return pool.limit(0).select(F.lit(0).alias("pos"), "id")
    rows = pool.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(k / total) - 1))))
    drawn = (F.col("cycle") if reshuffle_on_reset else F.lit(0)).cast("string")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cycle", "community").orderBy(draw(seed, drawn, F.col("id")), "id"))).where(F.col("r") <= k)
    place = F.struct(F.col("city_pos").alias("p")) if order is not None else F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), drawn, F.lit("c"), F.col("community").cast("string"))).alias("p"), F.col("community").alias("q"))
    first = rows.withColumn("place", place).orderBy("cycle", "r", "place").limit(k)
    return first.select((F.row_number().over(Window.orderBy("cycle", "r", "place")) - 1).alias("pos"), "id")


def farthest_first(graph: Graph, k: int, degree: DataFrame, among: DataFrame | None = None, small: int = SMALL_EDGES) -> DataFrame:
    """Starts at the largest degree; then again and again the vertex farthest from all chosen ones. Ties by id.

    Vertices that nothing reaches are farther than all. With `among`, only its ids are chosen. In a graph of at most
    `small` edges one task makes all choices, and a search from a new vertex goes only where it is nearer than the
    others; in larger ones each choice adds its vertex to the starts, and only blocks that it comes nearer to are searched again.
    """
    pool = graph.vertices.select("id") if among is None else among.select("id")
    ranked = pool.join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    spark = graph.vertices.sparkSession
    net = small_net(graph, small)
    if net is not None:
        shared = spark.sparkContext.broadcast(net)

        def run(rows):
            import pyarrow as pa

            n, ids = shared.value, np.array(rows["id"].to_pylist())
            order = np.lexsort((ids, -np.array(rows["degree"].to_pylist())))
            at, near, chosen = np.array(n.places(ids)), np.full(len(n.ids), np.inf), [int(ids[order[0]])]
            left = np.ones(len(ids), bool)
            while True:
                left[ids == chosen[-1]] = False
                if len(chosen) >= k or not left.any():
                    break
                (place,) = n.places([chosen[-1]])
                if place >= 0:
                    for i, (d, _) in n.reached([(0.0, 0, place)], near).items():
                        near[i] = d
                far = np.where(at >= 0, near[at], np.inf)
                far[~left] = -1
                chosen.append(int(ids[far == far.max()].min()))
            return pa.table({"pos": pa.array(range(len(chosen)), pa.int64()), "id": pa.array(chosen, pa.int64())})

        return ranked.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "pos long, id long")
    first = ranked.orderBy(F.col("degree").desc(), "id").first()
    if first is None:
        return spark.createDataFrame([], "pos long, id long")
    chosen, blocks, entries = [first["id"]], Blocks(graph), None
    pool = stored(pool, "pool")
    while len(chosen) < k:
        start = spark.createDataFrame([(0, chosen[-1], 0.0, 0)], "run long, id long, d double, owner long")
        entries = blocks.settled(start, entries)
        near = blocks.search(entries, entries.count(), False).select("id", "d")
        far = pool.where(~F.col("id").isin(chosen)).join(near, "id", "left").orderBy(F.col("d").desc_nulls_first(), "id").first()
        if far is None:
            break
        chosen.append(far["id"])
    if entries is not None:
        forget(entries)
    return spark.createDataFrame(list(enumerate(chosen)), "pos long, id long")


def city_order(matrix: DataFrame, reps: DataFrame) -> DataFrame:
    """(city_pos, community) by farthest-first over a distance matrix (a, b, d) of representatives.

    The matrix is one row a pair of communities, which the driver can hold.
    """
    ids = [r["id"] for r in reps.orderBy(F.col("degree").desc(), "id").select("id").collect()]
    d = {(r["a"], r["b"]): r["d"] for r in matrix.collect()}
    order, left = ids[:1], sorted(ids[1:])
    near = {i: d.get((i, order[0]), float("inf")) for i in left}
    while left:
        best = max(left, key=lambda i: (near[i], -i))
        order.append(best)
        left.remove(best)
        for i in left:
            near[i] = min(near[i], d.get((i, best), float("inf")))
    spark = reps.sparkSession
    return spark.createDataFrame(list(enumerate(order)), "city_pos long, id long").join(reps.select("id", "community"), "id").select("city_pos", "community")


def city_order_streaming(graph: Graph, degree: DataFrame, cities: int) -> DataFrame:
    """(city_pos, community) of the first `cities` communities by graph distance, with one relaxation for each chosen one.

    No matrix of representatives is made: what is kept is each one's distance to the nearest chosen. -1 is no community.
    """
    reps = stored(community_representatives(graph.vertices, degree), "reps")
    order = farthest_first(graph, cities, degree, reps)
    return order.join(reps.select("id", "community"), "id").select(F.col("pos").alias("city_pos"), "community")


def hybrid(vertices: DataFrame, k: int, seed: int, order: DataFrame) -> DataFrame:
    """Round robin over communities in the order of farthest-first traversal, the first k of them at most."""
    return round_robin(vertices, k, seed, order.where(F.col("city_pos") < k))


def sample(method: str, **args) -> DataFrame:
    methods = {"round_robin": round_robin, "fft": farthest_first, "hybrid": hybrid}
    if method not in methods:
        raise ValueError(f"unknown method: {method}")
    return methods[method](**args)
