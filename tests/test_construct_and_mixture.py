"""Chain contraction and the two-component mixture on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from geosieve.graph import Graph
from geosieve.operators import construct, scoring
from geosieve.plans import ranks


def contracted(spark, links, ids):
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(links)], "eid long, src long, dst long, length double, highway string")
    rows = construct.simplify_chains(Graph(spark.createDataFrame([(i,) for i in ids], "id long"), e)).collect()
    return sorted((r["src"], r["dst"], r["length"], r["parts"], r["highway"]) for r in rows)


def test_two_way_chains_are_contracted_in_each_direction(spark):
    # Junctions 0 and 9 with spurs; a two-way chain 0 = 1 = 2 = 9 of two classes.
    two = [(0, 1, 1.0, "b"), (1, 2, 2.0, "a"), (2, 9, 3.0, "b"), (0, 3, 5.0, "c"), (0, 4, 5.0, "c"), (9, 5, 6.0, "c"), (9, 6, 6.0, "c")]
    got = contracted(spark, two + [(b, a, w, h) for a, b, w, h in two], (0, 1, 2, 3, 4, 5, 6, 9))
    assert (0, 9, 6.0, 3, "a,b") in got and (9, 0, 6.0, 3, "a,b") in got and len(got) == 10


def test_one_way_chains_dead_ends_and_rings(spark):
    links = [(0, 1, 1.0, "a"), (1, 2, 2.0, "a"), (2, 9, 3.0, "a"), (9, 0, 10.0, "a")]  # a ring of its own: stays
    assert len(contracted(spark, links, (0, 1, 2, 9))) == 4
    # 1 is passed through, 5 isn't (both edges lead in), nor is 7 (both lead out); 8 has a loop.
    links = [(0, 1, 1.0, "a"), (1, 2, 2.0, "b"), (3, 5, 1.0, "a"), (4, 5, 1.0, "a"), (7, 3, 1.0, "a"), (7, 4, 1.0, "a"), (2, 8, 1.0, "a"), (8, 8, 4.0, "a"), (8, 3, 1.0, "a"), (0, 4, 1.0, "a")]
    got = contracted(spark, links, range(9))
    assert (0, 8, 4.0, 3, "a,b") in got and (8, 8, 4.0, 1, "a") in got and (3, 5, 1.0, 1, "a") in got and len(got) == 8
    # A way back to its beginning becomes a loop there.
    links = [(9, 5, 1.0, "a"), (5, 6, 1.0, "a"), (6, 9, 1.0, "a"), (9, 1, 1.0, "a"), (2, 9, 1.0, "a")]
    assert (9, 9, 3.0, 3, "a") in contracted(spark, links, (1, 2, 5, 6, 9))


def test_mixture_keeps_the_higher_component(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(-3, 0.5)) for i in range(60)] + [(60 + i, rng.gauss(3, 0.5)) for i in range(40)]
    kept = scoring.keep_urban(spark.createDataFrame(rows, "id long, urbanity_score double")).collect()
    assert sorted(r["id"] for r in kept) == list(range(60, 100)) and all(r["p_urban"] >= 0.5 for r in kept)


def test_mixture_of_nothing(spark):
    assert scoring.keep_urban(spark.createDataFrame([], "id long, urbanity_score double")).count() == 0


def test_noise_alone_is_cut_at_the_lower_quartile(spark):
    rows = spark.createDataFrame([(i, -1, float(i)) for i in range(9)], "id long, label long, score double")
    assert sorted(r["id"] for r in scoring.drop_rural(rows).collect()) == list(range(2, 9))


def test_knee_of_a_flat_curve(spark):
    flat = spark.createDataFrame([(i, 2.0) for i in range(5)], "id long, d double")
    assert scoring.knee_point(flat).first()["knee"] == 2.0 and scoring.knee_point(flat, flat=0.5).first()["knee"] == 0.5
    assert scoring.knee_point(flat.limit(1)).first()["knee"] == pytest.approx(0.1)


def test_places_and_percentiles_over_ranges(spark):
    rng = random.Random(5)
    values = [rng.choice([0.0, 0.0, rng.random(), None]) for _ in range(3000)]
    rows = spark.createDataFrame([*enumerate(values)], "id long, v double").repartition(7)
    got = {r["id"]: r["n"] for r in ranks.ranked(rows.where("v IS NOT NULL"), ["v", "id"], "n").collect()}
    known = sorted((v, i) for i, v in enumerate(values) if v is not None)
    assert got == {i: n for n, (_, i) in enumerate(known)}
    shares = [0.0, 0.25, 0.5, 0.9, 0.995, 1.0]
    exact = rows.agg(F.expr(f"percentile(v, array({', '.join(map(str, shares))}))")).first()[0]
    assert ranks.percentiles(rows, "v", shares) == pytest.approx(exact)
    assert ranks.percentiles(rows.limit(0), "v", shares) == [None] * 6 and ranks.ranked(rows.limit(0), ["v"], "n").count() == 0
