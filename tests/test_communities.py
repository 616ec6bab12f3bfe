"""Leiden, betweenness, density clusters, principal score and weight search against invariants and brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geosieve.graph import Graph
from geosieve.operators import density, distances, leiden, metrics, scoring


def test_leiden_separates_cliques(spark):
    links = [(a, b, 1.0) for base in (0, 10, 20) for a, b in itertools.combinations(range(base, base + 5), 2)] + [(4, 10, 0.1), (14, 20, 0.1)]
    v = spark.createDataFrame([(i,) for base in (0, 10, 20) for i in range(base, base + 5)] + [(99,)], "id long")
    rows = leiden.leiden(v, spark.createDataFrame(links, "a long, b long, weight double"), (1.0, 0.9), "modularity").collect()
    for run in (0, 1):
        got = {r["id"]: r["community"] for r in rows if r["run"] == run}
        assert len(got) == 16 and all(got[i] == (99 if i == 99 else i // 10 * 10) for i in got)
    best = leiden.sweep(spark.createDataFrame(rows)).where("best").collect()
    assert len(best) == 1 and best[0]["n"] == 4 and best[0]["q"] > 0.6
    with pytest.raises(ValueError):
        leiden.leiden(v, spark.createDataFrame(links, "a long, b long, weight double"), (1.0,), "other")


def test_leiden_without_edges(spark):
    v = spark.createDataFrame([(1,), (2,)], "id long")
    rows = leiden.leiden(v, spark.createDataFrame([], "a long, b long, weight double"), (0.5,)).collect()
    assert sorted((r["id"], r["community"]) for r in rows) == [(1, 1), (2, 2)]


def test_betweenness(spark):
    # A square 0-1-2-3 with a tail 3-4: two shortest paths between opposite corners share their weight.
    e = spark.createDataFrame([(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 3, 0, 1.0), (4, 3, 4, 2.0)], "eid long, src long, dst long, length double")
    v = spark.createDataFrame([(i,) for i in range(6)], "id long")
    got = {r["id"]: r["betweenness"] for r in distances.betweenness(Graph(v, e)).collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.5, 2: 1.0, 3: 3.5, 4: 0.0, 5: 0.0})


def test_density_clusters(spark):
    rng = random.Random(3)
    pts = [(i, rng.choice([0, 1, 5]) + rng.gauss(0, 0.2), rng.gauss(0, 0.2)) for i in range(150)] + [(150, 9.0, 9.0), (151, 9.0, 9.0)]
    eps, least = 0.15, 5
    x = np.array([p[1:] for p in pts])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(pts)), -1)
    for _ in pts:
        label = np.where(core, np.array([label[near[i] & core].min() if core[i] else -1 for i in range(len(pts))]), -1)
    want = [int(label[i]) if core[i] else int(min(label[near[i] & core], default=-1)) for i in range(len(pts))]
    got = {r["id"]: r["label"] for r in density.density_clusters(spark.createDataFrame(pts, "id long, x double, y double"), eps, least).collect()}
    assert [got[i] for i in range(len(pts))] == want and -1 in want


def test_density_clusters_of_copies(spark):
    """Where ten or more points lie at each one's place the knee is 0; points without a finite place are noise."""
    pts = [(i, 1.0, 2.0) for i in range(12)] + [(20 + i, -0.0, 5.0) for i in range(6)] + [(30 + i, 0.0, 5.0) for i in range(6)] + [(40, 1.0, 2.5), (41, 1.0, 2.5)]
    pts += [(50 + i, float("inf"), 0.0) for i in range(11)] + [(70 + i, None, 0.0) for i in range(11)] + [(90 + i, float("nan"), 0.0) for i in range(11)]
    rows = spark.createDataFrame(pts, "id long, x double, y double")
    want = {i: 0 if i < 12 else 20 if i < 40 else -1 for i, _, _ in pts}
    for eps, more in ((0.0, {}), (0.5, {40: 0, 41: 0}), (None, dict.fromkeys(want, -1))):
        assert {r["id"]: r["label"] for r in density.density_clusters(rows, eps, 10).collect()} == want | more



def test_principal_score(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3)) @ np.array([[2, 1, 0], [0, 1, 0], [0, 0, 0.5]])
    x -= x.mean(0)
    z = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = {r["id"]: r["urbanity_score"] for r in density.principal_score(z, ("a", "b", "c"), "a").collect()}
    w = np.linalg.svd(x)[2][0]
    assert [got[i] for i in range(40)] == pytest.approx(list(x @ (w if w[0] >= 0 else -w)), abs=1e-9)


def test_separation_penalises_wrong_signs(spark):
    rows = [(i, float(i), float(i), float(i), float(-i), float(-i), float(-i)) for i in range(10)]
    z = spark.createDataFrame(rows, ", ".join(["id long", *(f"{c} double" for c in ("log_degree", "clustering", "freq_residential", "avg_edge_len", "freq_motorway", "avg_maxspeed"))]))
    w = spark.createDataFrame([(0, [1.0] + [0.0] * 5), (1, [-1.0] + [0.0] * 5)], "trial long, w array<double>")
    got = {r["trial"]: r["objective"] for r in scoring.separation(z, w).collect()}
    assert got[0] == pytest.approx(8 * 3.95) and got[1] == pytest.approx(-8 * 3.95 - 16)


def test_evaluate(spark):
    v = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, 1, -1, 2])], "id long, community long")
    g = Graph(v, spark.createDataFrame([(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 3, 4, 5.0)], "eid long, src long, dst long, length double"))
    r = metrics.evaluate(g, spark.createDataFrame([(0, 1), (1, 4)], "pos long, id long")).first()
    assert (r["global_R_max"], r["global_mean"], r["global_median"], r["div_min_sep"], r["div_p90"]) == pytest.approx((2, 0.8, 1, 7, 7))
    r = metrics.evaluate(g, v.where("false").select(F.col("id").alias("pos"), "id")).first()
    assert r["cov"] == 0 and r["global_mean"] == float("inf") and r["ari"] is None


def test_comparison_leaves_out_samples_without_a_pair_as_its_sql_does(spark, tmp_path):
    import duckdb

    from geosieve.plans.registry import ORACLES, QUERIES

    early = {i for seed in (7, 8) for i in sorted(range(60), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())[:20]}
    late = [i for i in range(60) if i not in early][:12]
    rows = [(i, [float(i * i % 61), float(i * 7 % 59)], late.index(i) // 3 if i in late else 10 + i) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["compare_grid"](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(ORACLES["compare_grid"])
    at = [got.columns.index(c) for c in want.columns]
    assert sorted(tuple(r[i] for i in at) for r in got.collect()) == sorted(want.fetchall())
