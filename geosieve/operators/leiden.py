"""Communities by local moving, refinement into connected parts, and aggregation, for several resolutions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.operators.connectivity import components
from geosieve.plans.storage import stored

#: Resolutions of the sweep by objective (fixed values).
GAMMAS = {"CPM": (0.001, 0.003, 0.005, 0.01, 0.02, 0.05), "modularity": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)}


def _moved(links: DataFrame, nodes: DataFrame, rounds: int, level: int) -> DataFrame:
    """(id, c) after synchronous rounds of local moves; in each, half of the nodes (by md5) may move.

    Moving a node of mass k from its community to c gains w(node, c) - rate k M(c), with M the mass of c without
    the node: this is the gain of both objectives up to a factor. Only sums by community are ever gathered.
    """
    label = stored(nodes.select("id", F.col("id").alias("c")), "leiden")
    for step in range(rounds):
        mass = nodes.join(label, "id").groupBy("c").agg(F.sum("k").alias("mass"))
        near = links.join(label.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
        offers = near.unionByName(label.withColumn("w", F.lit(0.0))).groupBy("id", "c").agg(F.sum("w").alias("w"))
        own = nodes.join(label.withColumnRenamed("c", "old"), "id")
        priced = offers.join(own, "id").join(mass, "c").select("id", "old", "c", F.round(F.col("w") - F.col("rate") * F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0.0)), 12).alias("gain"))
        best = priced.groupBy("id", "old").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("b"), F.max(F.when(F.col("c") == F.col("old"), F.col("gain"))).alias("stay"))
        wants = F.col("b.gain") > F.col("stay")
        coin = F.substring(F.md5(F.concat_ws(":", F.lit(str(level)), F.lit(str(step)), F.col("id").cast("string"))), 1, 1) < "8"
        after = stored(best.select("id", F.when(wants & coin, -F.col("b.c")).otherwise(F.col("old")).alias("c"), wants.alias("wants")), "leiden")
        label = after.select("id", "c")
        if after.where("wants").limit(1).count() == 0:
            break
    return label


def leiden(vertices: DataFrame, edges: DataFrame, gammas: tuple, objective: str = "CPM", levels: int = 10, rounds: int = 12) -> DataFrame:
    """(run, gamma, id, community, q): a partition for each resolution, with its modularity.

    edges: undirected (a, b, weight), loops ignored. A community is connected and named by its least id. All runs
    go through the rounds together, as copies of the graph, so a sweep takes as many jobs as a single run. Of the
    levels of each run the one with the best value of its objective is returned. No randomness but md5 of ids:
    reruns agree. Vertices without edges stay alone.
    """
    if objective not in GAMMAS:
        raise ValueError(f"unknown objective: {objective}")
    spark, n = vertices.sparkSession, len(gammas)
    plain = stored(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").cast("double").alias("w")), "leiden")
    total = plain.agg(F.sum("w")).first()[0] or 1.0
    copies = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("run"), F.lit(float(g)).alias("gamma")) for i, g in enumerate(gammas)))).alias("g")
    here = lambda c: (F.col(c) * n + F.col("g.run")).alias(c)
    ends = plain.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "w"), F.struct(F.col("b").alias("id"), "w"))).alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.w").alias("degree"))
    base = vertices.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"), copies)
    by_degree = objective == "modularity"
    first = stored(base.select(here("id"), F.col("degree"), F.lit(1.0).alias("one"), (F.col("degree") if by_degree else F.lit(1.0)).alias("k"), (F.col("g.gamma") / (2 * total) if by_degree else F.col("g.gamma")).alias("rate")), "leiden")
    pairs = stored(plain.select("a", "b", "w", copies).select(here("a"), here("b"), "w"), "leiden")
    member = first.select("id", F.col("id").alias("c"))
    nodes, links, known = first, pairs, None
    for level in range(levels):
        both = stored(links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(links.select("b", "a", "w")), "leiden")
        label = _moved(both, nodes, rounds, level)
        inside = links.join(label.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb")
        part = stored(components(nodes, inside.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "leiden")
        member = stored(member.join(part.select(F.col("id").alias("c"), "component"), "c").select("id", F.col("component").alias("c")), "leiden")
        at = member.withColumn("level", F.lit(level))
        known = at if known is None else known.unionByName(at)
        if part.where("id <> component").limit(1).count() == 0:
            break
        nodes = stored(nodes.join(part, "id").groupBy(F.col("component").alias("id")).agg(F.sum("k").alias("k"), F.max("rate").alias("rate")), "leiden")
        joined = links.join(part.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(part.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        links = stored(joined.where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")), "leiden")
    # Values of every level and run: weight inside, less what the masses predict.
    left, right = (known.select("level", F.col("id").alias(e), F.col("c").alias(f"c{e}")) for e in ("a", "b"))
    inner = pairs.join(left, "a").join(right, ["level", "b"]).where("ca = cb").groupBy("level", F.col("ca").alias("c")).agg(F.sum("w").alias("w"))
    outer = known.join(first, "id").groupBy("level", "c").agg(F.sum("k").alias("k"), F.sum("degree").alias("degree"), F.max("rate").alias("rate"))
    value = outer.join(inner, ["level", "c"], "left").groupBy((F.col("c") % n).alias("run"), "level").agg(F.sum(F.coalesce("w", F.lit(0.0)) - F.col("rate") * F.col("k") * F.col("k") / 2).alias("value"), F.sum(F.coalesce("w", F.lit(0.0)) / total - (F.col("degree") / (2 * total)) * (F.col("degree") / (2 * total))).alias("q"))
    best = value.groupBy("run").agg(F.max(F.struct(F.round("value", 9).alias("value"), "level", "q")).alias("b")).select("run", "b.level", "b.q")
    names = spark.createDataFrame([(i, float(g)) for i, g in enumerate(gammas)], "run long, gamma double")
    rows = known.withColumn("run", F.col("id") % n).join(F.broadcast(best), ["run", "level"]).join(F.broadcast(names), "run")
    return rows.select("run", "gamma", F.expr(f"id div {n}").alias("id"), F.expr(f"c div {n}").alias("community"), "q")


def sweep(partitions: DataFrame) -> DataFrame:
    """A row for each resolution: run, gamma, q, n, min_size, median_size, max_size and best (largest q, first on ties)."""
    sizes = partitions.groupBy("run", "gamma", "q", "community").agg(F.count(F.lit(1)).alias("size"))
    rows = sizes.groupBy("run", "gamma", "q").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("min_size"), F.expr("percentile(size, 0.5)").alias("median_size"), F.max("size").alias("max_size"))
    return rows.withColumn("best", F.row_number().over(Window.orderBy(F.round("q", 9).desc(), "run")) == 1)
