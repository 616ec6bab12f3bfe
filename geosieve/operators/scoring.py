"""Urbanity: feature matrix, scaling, the separation objective, random search, a two-component mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosieve.functions import draw, finite
from geosieve.plans.ranks import percentiles, ranked
from geosieve.plans.storage import stored

#: Order of the matrix, and signed ranges of the search (fixed values).
FEATURES = ("log_degree", "clustering", "freq_residential", "avg_edge_len", "freq_motorway", "avg_maxspeed")
RANGES = {"log_degree": (0.6, 1.8), "clustering": (0.1, 1.0), "freq_residential": (0.2, 1.6), "avg_edge_len": (-1.8, -0.2), "freq_motorway": (-1.6, -0.1), "avg_maxspeed": (-1.8, -0.2)}
#: What the principal score weighs (fixed values); betweenness is left at 0 there, so it has no part in a component.
PRINCIPAL = ("degree", "avg_edge_len", "betweenness", "clustering_coeff", "freq_residential", "freq_primary", "freq_motorway", "freq_service", "freq_other", "avg_maxspeed")
#: How each difference between the top and bottom counts, and what a wrong sign costs (fixed values).
PARTS = {"log_degree": (1.0, 5.0), "freq_residential": (0.8, 3.0), "clustering": (0.25, 0.0), "avg_edge_len": (-0.8, 3.0), "freq_motorway": (-0.6, 3.0), "avg_maxspeed": (-0.5, 2.0)}


def winsorized(rows: DataFrame, columns: list[str], p: float = 0.995) -> DataFrame:
    """Clips each column above its exact percentile; `rows` is read once for each column, and once more."""
    tops = {c: percentiles(rows, c, [p])[0] for c in columns}
    return rows.select(*(F.least(F.col(c), F.lit(tops[c])).alias(c) if c in columns else F.col(c) for c in rows.columns))


def feature_matrix(features: DataFrame, cap: float = 0.995) -> DataFrame:
    """id and FEATURES: finite, logged degree, lengths and speeds clipped."""
    f = lambda c: finite(F.col(c).cast("double"))
    m = features.select("id", F.log1p(f("degree")).alias("log_degree"), f("clustering_coeff").alias("clustering"), f("freq_residential").alias("freq_residential"), f("avg_edge_len").alias("avg_edge_len"), f("freq_motorway").alias("freq_motorway"), f("avg_maxspeed").alias("avg_maxspeed"))
    return winsorized(stored(m, "matrix"), ["avg_edge_len", "avg_maxspeed"], cap)


def zscored(rows: DataFrame, columns: tuple = FEATURES) -> DataFrame:
    """Population z-scores; a constant column becomes 0."""
    s = rows.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    return rows.crossJoin(F.broadcast(s)).select("id", *(((F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(f"_s_{c}", F.lit(0.0)), F.lit(1.0))).alias(c) for c in columns))


def score(z: DataFrame, weights: dict[str, float]) -> DataFrame:
    return z.select("id", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)).alias("urbanity_score"))


def keep_urban(scores: DataFrame, threshold: float = 0.5, rounds: int = 200, tol: float = 1e-6) -> DataFrame:
    """id, urbanity_score, p_urban of those kept: posterior of the component of larger mean in a mixture of two normals.

    Expectation-maximisation from the quartiles; each round is one aggregate.
    """
    x = stored(scores.select("id", "urbanity_score"), "scores")
    mean, spread = percentiles(x, "urbanity_score", [0.25, 0.75]), x.agg(F.var_pop("urbanity_score")).first()[0]
    if spread is None:
        return x.withColumn("p_urban", F.lit(None).cast("double"))
    var, part = [max(spread, 1e-9)] * 2, [0.5, 0.5]

    def posterior():
        density = [F.lit(part[i] / var[i] ** 0.5) * F.exp(-((F.col("urbanity_score") - mean[i]) ** 2) / (2 * var[i])) for i in (0, 1)]
        far = F.when(F.abs(F.col("urbanity_score") - mean[1]) < F.abs(F.col("urbanity_score") - mean[0]), 1.0).otherwise(0.0)
        return F.when(density[0] + density[1] > 0, density[1] / (density[0] + density[1])).otherwise(far)

    for _ in range(rounds):
        u, p = F.col("urbanity_score"), posterior()
        r = x.agg(F.sum(p).alias("n1"), F.sum(p * u).alias("s1"), F.sum(p * u * u).alias("t1"), F.count(u).alias("n"), F.sum(u).alias("s"), F.sum(u * u).alias("t")).first()
        n = [r["n"] - r["n1"], r["n1"]]
        if min(n) < 1e-9:
            break
        new = [(r["s"] - r["s1"]) / n[0], r["s1"] / n[1]]
        var = [max((r["t"] - r["t1"]) / n[0] - new[0] ** 2, 1e-9), max(r["t1"] / n[1] - new[1] ** 2, 1e-9)]
        part, moved, mean = [c / r["n"] for c in n], max(abs(a - b) for a, b in zip(mean, new)), new
        if moved < tol:
            break
    p = posterior() if mean[1] >= mean[0] else 1 - posterior()
    return x.withColumn("p_urban", p).where(F.col("p_urban") >= threshold)


def sample_rows(rows: DataFrame, n: int, seed: int) -> DataFrame:
    return rows.orderBy(draw(seed, F.col("id")), "id").limit(n)


def knee_point(distances: DataFrame, flat: float | None = None) -> DataFrame:
    """Of the sorted distances the one farthest from the chord between first and last; 0.1 below two points.

    Where the chord has no length the first distance, or `flat` if given (the other legacy form takes 0.5).
    """
    p = stored(ranked(distances.select("d", "id"), ["d", "id"], "i").select("d", F.col("i").cast("double").alias("i")), "knee")
    ends = p.agg(F.max("i").alias("n"), F.min("d").alias("y0"), F.max("d").alias("y1"))
    off = F.abs(F.col("n") * (F.col("d") - F.col("y0")) - F.col("i") * (F.col("y1") - F.col("y0")))
    best = p.crossJoin(F.broadcast(ends)).agg(F.max_by("d", F.struct(F.round(off, 9), -F.col("i"))).alias("knee"), F.count(F.lit(1)).alias("c"), F.min("d").alias("y0"), F.max("d").alias("y1"))
    ends_equal = F.col("y0") == F.col("y1")
    level = F.col("knee") if flat is None else F.when(ends_equal, F.lit(float(flat))).otherwise(F.col("knee"))
    return best.select(F.when(F.col("c") < 2, 0.1).otherwise(level).alias("knee"))


def drop_rural(labelled: DataFrame) -> DataFrame:
    """(id, label, score) without the cluster of lowest mean score; noise (-1) stays. Of noise alone, scores from the lower quartile on."""
    if labelled.where("label <> -1").limit(1).count() == 0:
        quarter = percentiles(labelled, "score", [0.25])[0]
        return labelled.where(F.col("score") >= F.lit(quarter))
    low = labelled.where("label <> -1").groupBy("label").agg(F.avg("score").alias("m")).orderBy("m", "label").limit(1).select("label")
    return labelled.join(F.broadcast(low), "label", "left_anti")


def drawn_weights(spark: SparkSession, trials: int, seed: int) -> DataFrame:
    """(trial, w): weights in RANGES from md5 of seed, trial and feature, of length 1; in the order of FEATURES."""
    t = spark.range(trials).select(F.col("id").alias("trial"))
    part = lambda c: F.conv(F.substring(draw(seed, F.col("trial"), F.lit(c)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    raw = t.select("trial", *((RANGES[c][0] + (RANGES[c][1] - RANGES[c][0]) * part(c)).alias(c) for c in FEATURES))
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in FEATURES), F.lit(0.0))) + 1e-8
    return raw.select("trial", F.array(*(F.col(c) / norm for c in FEATURES)).alias("w"))


def separation(z: DataFrame, weights: DataFrame, q: float = 0.2) -> DataFrame:
    """(trial, objective, d_<feature>): how far top and bottom q of the score lie apart, for each weight vector.

    `weights` is a stated set of trials (some hundred rows, made by the driver), each of which scores all rows; it is
    what is sent to the tasks. Cuts are exact percentiles of each trial, ends included.
    """
    made = sum((F.col(c) * F.get("w", F.lit(i)) for i, c in enumerate(FEATURES)), F.lit(0.0))
    s = z.crossJoin(F.broadcast(weights)).select("trial", *FEATURES, made.alias("s"))
    cuts = s.groupBy("trial").agg(F.expr(f"percentile(s, array({q}, {1 - q}))").alias("cut"))
    top, bottom = F.col("s") >= F.get("cut", F.lit(1)), F.col("s") <= F.get("cut", F.lit(0))
    d = s.join(F.broadcast(cuts), "trial").groupBy("trial").agg(*((F.avg(F.when(top, F.col(c))) - F.avg(F.when(bottom, F.col(c)))).alias(f"d_{c}") for c in FEATURES))
    cost = F.lit(0.0)
    for c, (sign, penalty) in PARTS.items():
        wrong = F.col(f"d_{c}") < 0 if sign > 0 else F.col(f"d_{c}") > 0
        cost = cost + sign * F.col(f"d_{c}") - F.when(wrong, penalty).otherwise(0.0)
    return d.select("trial", cost.alias("objective"), *(f"d_{c}" for c in FEATURES))


def tuned_weights(z: DataFrame, trials: int = 800, sample: int = 80_000, q: float = 0.2, seed: int = 0) -> DataFrame:
    """The drawn weights of the best objective, first on ties: trial, objective, FEATURES as weights. Over a sample of rows."""
    rows = stored(sample_rows(z, sample, seed), "tuning")
    weights = stored(drawn_weights(z.sparkSession, trials, seed), "tuning")
    best = separation(rows, weights, q).orderBy(F.round("objective", 9).desc(), "trial").limit(1)
    return best.join(weights, "trial").select("trial", "objective", *(F.get("w", F.lit(i)).alias(c) for i, c in enumerate(FEATURES)))
