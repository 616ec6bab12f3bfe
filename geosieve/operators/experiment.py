"""Samplers side by side: all algorithms, sizes and repeats, and what each sample is worth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.functions import draw
from geosieve.graph import Graph
from geosieve.operators import metrics, samplers
from geosieve.plans.storage import stored

#: Names of the algorithms in results (fixed values).
ALGORITHMS = {"full_random": "Dummy 1 (Full Random)", "pruned_random": "Dummy 2 (Pruned Random)", "round_robin": "Pipeline (Smart: round_robin)", "fft": "Pipeline (Smart: fft)", "hybrid": "Pipeline (Smart: hybrid)"}


def drawn(full: DataFrame, pruned: Graph, degree: DataFrame, order: DataFrame, ks: tuple[int, ...], repeats: int, seed: int, algorithms: tuple[str, ...] = tuple(ALGORITHMS)) -> DataFrame:
    """(algo, k, repeat, pos, id): a sample of the largest k for each algorithm and repeat, whose prefixes are the others.

    `full` has the vertices before pruning; `order` is that of hybrid. Farthest-first has no seed, so one sample serves
    all repeats. Hybrid restricts its communities to the first k, so it is drawn for each k.
    """
    if unknown := set(algorithms) - set(ALGORITHMS):
        raise ValueError(f"unknown algorithm: {', '.join(sorted(unknown))}")
    parts, most = [], max(ks)
    far = stored(samplers.farthest_first(pruned, most, degree), "fft") if "fft" in algorithms else None

    def add(algo: str, repeat: int, k: int, rows: DataFrame) -> None:
        parts.append(rows.where(F.col("pos") < k).select(F.lit(ALGORITHMS[algo]).alias("algo"), F.lit(k).cast("long").alias("k"), F.lit(repeat).cast("long").alias("repeat"), F.col("pos").cast("long").alias("pos"), "id"))

    for repeat in range(repeats):
        own = seed + repeat
        made = {"full_random": lambda: samplers.uniform(full, most, own), "pruned_random": lambda: samplers.uniform(pruned.vertices, most, own), "round_robin": lambda: samplers.round_robin(pruned.vertices, most, own)}
        for algo in algorithms:
            whole = far if algo == "fft" else stored(made[algo](), "sample") if algo in made else None
            for k in ks:
                add(algo, repeat, k, samplers.hybrid(pruned.vertices, k, own, order) if whole is None else whole)
    return stored(reduce(DataFrame.unionByName, parts), "samples")


def compare(full: DataFrame, pruned: Graph, degree: DataFrame, order: DataFrame, ks: tuple[int, ...] = (10, 20, 50, 100, 200, 500), repeats: int = 5, seed: int = 0, algorithms: tuple[str, ...] = tuple(ALGORITHMS), eval_subset: int = 0) -> DataFrame:
    """algo, k, repeat, seed, k_eff and all measures of each sample.

    Efficiency says what part of a sample of the full graph lies in the pruned one; the others' is 1. With eval_subset,
    global distances are of so many vertices, drawn by seed.
    """
    samples = drawn(full, pruned, degree, order, ks, repeats, seed, algorithms)
    targets = None
    if 0 < eval_subset:
        targets = stored(pruned.vertices.select("id").orderBy(draw(seed, F.col("id")), "id").limit(eval_subset), "targets")
    rows = metrics.evaluate_runs(pruned, samples, targets)
    own = F.when(F.col("algo") == ALGORITHMS["full_random"], F.col("efficiency")).otherwise(1.0)
    return rows.select("algo", "k", "repeat", (F.col("repeat") + seed).alias("seed"), "k_eff", *(own.alias(c) if c == "efficiency" else F.col(c) for c in metrics.MEASURES))
