"""How well a sample covers a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.graph import Graph
from geosieve.operators.distances import nearest_center, replace_infinite, shortest_paths
from geosieve.plans.ranks import percentiles
from geosieve.plans.storage import stored


def coverage(vertices: DataFrame, sample: DataFrame, legacy: bool = False, keep_noise: bool = False) -> DataFrame:
    """Communities with a sampled vertex by all of them. -1 counts in neither; with `legacy` above the line, with `keep_noise` on both sides."""
    counts = vertices.join(sample.select("id").distinct(), "id").where("true" if legacy or keep_noise else "community <> -1").groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    full = vertices.where("true" if keep_noise else "community <> -1").agg(F.count_distinct("community").alias("n_comm_full"))
    got = counts.agg(F.count(F.lit(1)).alias("n_comm_repr"))
    return full.crossJoin(got).select("n_comm_full", "n_comm_repr", (F.col("n_comm_repr") / F.nullif("n_comm_full", F.lit(0))).alias("cov"))


def balance(vertices: DataFrame, sample: DataFrame) -> DataFrame:
    """Variation and normed entropy of the sampled counts of communities."""
    counts = vertices.where("community <> -1").join(sample.select("id").distinct(), "id").groupBy("community").agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = counts.agg(F.stddev_pop("n").alias("sd"), F.avg("n").alias("mean"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.log("total") - F.col("nlogn") / F.col("total")
    return s.select((F.col("sd") / F.col("mean")).alias("balance_cv"), F.when(F.col("m") == 1, 1.0).otherwise(entropy / F.log("m")).alias("balance_entropy"))


def distance_summary(distances: DataFrame, names: dict[str, str]) -> DataFrame:
    """Aggregates of d by name: max, min, mean, or p<percent> (exact, interpolated)."""
    rows = stored(distances, "distances")
    cuts = [name for name, kind in names.items() if kind.startswith("p")]
    values = dict(zip(cuts, percentiles(rows, "d", [int(names[c][1:]) / 100 for c in cuts])))
    whole = rows.agg(F.max("d").alias("max"), F.min("d").alias("min"), F.avg("d").alias("mean"))
    return whole.select(*(F.lit(values[name]).cast("double").alias(name) if name in values else F.col(kind).alias(name) for name, kind in names.items()))


GLOBAL = {"global_R_max": "max", "global_mean": "mean", "global_median": "p50", "global_p90": "p90"}
DIVERSITY = {"div_min_sep": "min", "div_mean": "mean", "div_median": "p50", "div_p10": "p10", "div_p90": "p90"}


def agreement(labels: DataFrame) -> DataFrame:
    """ari and nmi of (label, owner), of rows with owner <> -1, from the contingency table."""
    table = labels.where("owner <> -1").groupBy("label", "owner").agg(F.count(F.lit(1)).cast("double").alias("n"))
    a, b = (table.groupBy(c).agg(F.sum("n").alias("n")) for c in ("label", "owner"))
    pairs = lambda t, p: t.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"{p}2"), F.sum(F.col("n") * F.log("n")).alias(f"{p}l"), F.sum("n").alias(f"{p}n"))
    r = pairs(table, "t").crossJoin(pairs(a, "a")).crossJoin(pairs(b, "b"))
    n = F.col("tn")
    e = F.col("a2") * F.col("b2") / (n * (n - 1) / 2)
    top = (F.col("a2") + F.col("b2")) / 2
    ha, hb = F.log(n) - F.col("al") / n, F.log(n) - F.col("bl") / n
    mutual = ha + hb - (F.log(n) - F.col("tl") / n)
    return r.select(F.when(top - e == 0, 1.0).otherwise((F.col("t2") - e) / (top - e)).alias("ari"), F.when(ha + hb == 0, 1.0).otherwise(mutual / ((ha + hb) / 2)).alias("nmi"))


def efficiency(mapped: DataFrame, k: int) -> DataFrame:
    return mapped.agg(F.count_distinct("id").alias("k_eff")).withColumn("efficiency", F.col("k_eff") / k)


def aggregate_runs(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric by (algo, k); NaN counts as missing, no deviation as 0."""
    clean = lambda m: F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))
    out = [f(m) for m in metrics for f in (lambda m: F.avg(clean(m)).alias(f"{m}_mean"), lambda m: F.coalesce(F.stddev_pop(clean(m)), F.lit(0.0)).alias(f"{m}_std"))]
    return rows.groupBy("algo", "k").agg(*out)


def pair_distances(graph: Graph, sample: DataFrame) -> DataFrame:
    """(p, q, d) of each two positions of a sample; d is null where no path is."""
    d = shortest_paths(graph, sample)
    p, q = sample.select(F.col("pos").alias("p"), F.col("id").alias("source")), sample.select(F.col("pos").alias("q"), "id")
    return p.join(q, F.col("p") < F.col("q")).join(d, ["source", "id"], "left").select("p", "q", "d")


def evaluate(graph: Graph, sample: DataFrame) -> DataFrame:
    """All measures of a sample (pos, id) in one row; of an empty one: coverage 0, infinite distances, diversity 0, the rest missing."""
    sample = stored(sample.select("pos", "id"), "sample")
    if sample.limit(1).count() == 0:
        full = graph.vertices.where("community <> -1").agg(F.count_distinct("community").alias("n_comm_full"))
        far = [F.lit(float("inf")).alias(c) for c in GLOBAL]
        return full.select("n_comm_full", F.lit(0).alias("n_comm_repr"), F.lit(0.0).alias("cov"), F.lit(float("nan")).alias("balance_cv"), F.lit(float("nan")).alias("balance_entropy"), *far, *(F.lit(0.0).alias(c) for c in DIVERSITY), F.lit(None).cast("double").alias("ari"), F.lit(None).cast("double").alias("nmi"))
    near = stored(nearest_center(graph, sample), "near")
    rows = coverage(graph.vertices, sample).crossJoin(balance(graph.vertices, sample))
    rows = rows.crossJoin(distance_summary(replace_infinite(near, []), GLOBAL))
    rows = rows.crossJoin(distance_summary(replace_infinite(pair_distances(graph, sample), []), DIVERSITY))
    return rows.crossJoin(agreement(near.join(graph.vertices.select("id", F.col("community").alias("label")), "id")))


#: The measures of an experiment, and those that are drawn (fixed values).
MEASURES = ("efficiency", "cov", "balance_cv", "balance_entropy", "global_R_max", "global_mean", "global_median", "global_p90", "div_min_sep", "div_mean", "div_median", "div_p10", "div_p90")
DRAWN = ("efficiency", "cov", "global_R_max", "global_p90", "div_min_sep", "div_p10", "balance_cv", "balance_entropy")


def evaluate_runs(graph: Graph, samples: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """A row of MEASURES for each (algo, k, repeat) of `samples` (algo, k, repeat, pos, id), and k_eff.

    Samples may hold ids outside the graph, or an id twice: k_eff counts the distinct ones inside, efficiency is k_eff by k,
    and only they are measured. All samples are searched together, each vertex keeping one distance for each. With
    `targets` (id), global distances are of those vertices only.
    """
    keys = ["algo", "k", "repeat"]
    inside = samples.join(graph.vertices.select("id"), "id").groupBy(*keys, "id").agg(F.min("pos").alias("pos"))
    inside = stored(inside, "inside")
    runs = samples.select(*keys).distinct()
    count = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("k_eff"))
    label = graph.vertices.where("community <> -1").select("id", "community")
    full = label.agg(F.count_distinct("community").alias("full"))
    by = inside.join(label, "id").groupBy(*keys, "community").agg(F.count(F.lit(1)).cast("double").alias("n"))
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    even = by.groupBy(*keys).agg(F.count(F.lit(1)).alias("got"), (F.stddev_pop("n") / F.avg("n")).alias("balance_cv"), F.when(F.count(F.lit(1)) == 1, 1.0).otherwise(entropy / F.log(F.count(F.lit(1)))).alias("balance_entropy"))
    near = stored(nearest_center(graph, inside, tuple(keys)), "near")
    near = near if targets is None else near.join(targets.select("id").distinct(), "id", "left_semi")
    paths = shortest_paths(graph, inside).join(inside.select("id").distinct(), "id", "left_semi")
    p, q = inside.select(*keys, F.col("pos").alias("p"), F.col("id").alias("source")), inside.select(*keys, F.col("pos").alias("q"), "id")
    pairs = p.join(q, keys).where("p < q").join(paths, ["source", "id"], "left")
    part = lambda rows, names: replace_infinite(rows, keys).groupBy(*keys).agg(*_summaries(names))
    out = runs.join(count, keys, "left").join(even, keys, "left").join(part(near, GLOBAL), keys, "left").join(part(pairs, DIVERSITY), keys, "left").crossJoin(F.broadcast(full))
    far = float("inf")
    none = {"k_eff": F.lit(0), "cov": F.lit(0.0)} | dict.fromkeys(GLOBAL, F.lit(far)) | dict.fromkeys(DIVERSITY, F.lit(0.0))
    out = out.withColumn("cov", F.col("got") / F.nullif("full", F.lit(0))).withColumn("efficiency", F.coalesce("k_eff", F.lit(0)) / F.col("k"))
    empty = F.col("k_eff").isNull()
    return out.select(*keys, *(F.when(empty, none[c]).otherwise(F.col(c)).alias(c) if c in none else F.col(c) for c in ("k_eff", *MEASURES)))


def _summaries(names: dict[str, str]) -> list:
    made = {"max": F.max("d"), "min": F.min("d"), "mean": F.avg("d")}
    return [(made.get(kind) if kind in made else F.expr(f"percentile(d, {int(kind[1:]) / 100})")).alias(name) for name, kind in names.items()]
