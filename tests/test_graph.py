"""Hand-worked cases on small graphs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from geosieve.functions import parse_maxspeed
from geosieve.graph import Graph, induced
from geosieve.operators import communities, connectivity, distances, features, metrics, plane, samplers
from geosieve.sources import embedding_graph, read_graph, seeds_folder, write_graph, write_results


@pytest.fixture(scope="module")
def roads(spark):
    v = spark.createDataFrame([(i,) for i in range(6)], "id long")
    rows = [(0, 0, 1, 100.0, "residential", "50"), (1, 1, 2, 200.0, "primary", "30 mph"), (2, 2, 0, 300.0, "residential,service", None), (3, 2, 3, 1000.0, "motorway", "none"), (4, 3, 2, 1000.0, "motorway", "120"), (5, 3, 4, 500.0, None, "DE:urban")]
    return Graph(v, spark.createDataFrame(rows, "eid long, src long, dst long, length double, highway string, maxspeed string"))


@pytest.fixture(scope="module")
def path(spark):
    v = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, 1, -1, 2])], "id long, community long")
    return Graph(v, spark.createDataFrame([(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 3, 4, 5.0)], "eid long, src long, dst long, length double"))


def test_features(roads):
    got = {r["id"]: r for r in features.node_features(roads).collect()}
    assert [got[i]["degree"] for i in range(6)] == [2, 2, 4, 3, 1, 0]
    assert [round(got[i]["clustering_coeff"], 6) for i in range(6)] == [1, 1, round(1 / 3, 6), 0, 0, 0]
    assert [got[i]["avg_edge_len"] for i in range(6)] == [100, 200, 650, 750, 0, 0]
    assert [got[i]["avg_maxspeed"] for i in range(6)] == [50, 40, 75, 120, 0, 0]
    assert got[2]["freq_motorway"] == 0.5 and got[0]["freq_other"] == 0.5


def test_maxspeed(spark):
    values = ["50", "30 mph", "DE:30", "50,30", "none", "signals", "variable", "walk", " Walk ", "DE:urban", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    assert [r[0] for r in rows.select(parse_maxspeed(F.col("v"))).collect()] == [50, 30, 30, 50] + [None] * 7


def test_farthest_first_and_coverage(spark, path):
    degree = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, 2), (4, 1)], "id long, degree long")
    assert [r["id"] for r in samplers.farthest_first(path, 5, degree).orderBy("pos").collect()] == [1, 4, 3, 0, 2]
    near = distances.nearest_center(path, spark.createDataFrame([(0, 1), (1, 4)], "pos long, id long")).orderBy("id").collect()
    assert [r["d"] for r in near] == [1, 0, 1, 2, 0] and [r["owner"] for r in near] == [0, 0, 0, 0, 1]


def test_coverage_drops_noise(spark, path):
    s = spark.createDataFrame([(0, 0), (1, 3)], "pos long, id long")
    assert metrics.coverage(path.vertices, s).first()["cov"] == pytest.approx(1 / 3)
    assert metrics.coverage(path.vertices, s, legacy=True).first()["cov"] == pytest.approx(2 / 3)
    assert metrics.coverage(path.vertices, s, keep_noise=True).first()["cov"] == pytest.approx(1 / 2)


def test_balance_and_agreement(spark):
    v = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, 0, 1])], "id long, community long")
    r = metrics.balance(v, v.select(F.col("id").alias("pos"), "id")).first()
    assert r["balance_cv"] == pytest.approx(0.5) and r["balance_entropy"] == pytest.approx(0.811278, abs=1e-6)
    r = metrics.agreement(spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "label long, owner long")).first()
    assert r["ari"] == pytest.approx(0.571429, abs=1e-6) and r["nmi"] == pytest.approx(0.8)


def test_connect(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 0.0), (2, 10.0, 0.0)], "id long, x double, y double")
    g = Graph(v, spark.createDataFrame([], "eid long, src long, dst long, length double"))
    assert sorted((r["src"], r["dst"], r["length"]) for r in connectivity.connect(g).collect()) == [(0, 1, 4.5), (1, 2, 10.5)]


def test_nearest_in_plane_equals_all_pairs(spark):
    rng = random.Random(8)
    points = [(i, rng.random(), rng.random() ** 4) for i in range(120)] + [(200 + i, 5.0, 5.0) for i in range(9)] + [(300, 90.0, -40.0)]
    got = {}
    for r in connectivity.nearest_in_plane(spark.createDataFrame(points, "id long, x double, y double"), 5).collect():
        got.setdefault(r["a"], []).append((r["d"], r["b"]))
    for i, x, y in points:
        want = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in points if j != i)[:5]
        assert sorted(got[i]) == want


def test_embedding_graph_without_all_pairs(spark, tmp_path, monkeypatch):
    """Copies, points on a line, and places that are null or not finite: the same edges as from all pairs, by (d, id), nulls last."""
    monkeypatch.setattr(plane, "CELL_PLACES", 16)
    rng = random.Random(3)
    places = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)] + [(2.0, 2.0)] * 60 + [(i / 7, -3.0) for i in range(40)]
    places += [(math.inf, 0.0), (-math.inf, 1.0), (math.nan, 0.0), (None, 1.0), (0.5, None), (math.inf, 2.0)]
    rng.shuffle(places)
    rows = [(i, [x, y], i % 3) for i, (x, y) in enumerate(places)] + [(len(places), None, 0), (len(places) + 1, [1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    graph = embedding_graph(spark, str(tmp_path))
    plan = graph.edges._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    place = {i: (*(e or []), None, None)[:2] for i, e, _ in rows}

    def far(a, b):
        (x, y), (u, v) = place[a], place[b]
        if None in (x, y, u, v):
            return (2, 0.0, b)
        d = math.sqrt((x - u) * (x - u) + (y - v) * (y - v))
        return (1, 0.0, b) if math.isnan(d) else (0, d, b)

    want = [(a * 3 + r, a, k[2]) for a in place for r, k in enumerate(sorted(far(a, b) for b in place if b != a)[:3])]
    assert sorted((r["eid"], r["src"], r["dst"]) for r in graph.edges.collect()) == want


def test_connect_many_components(spark):
    # Two groups of twelve single vertices, so far apart that the nearest neighbours leave two trees.
    v = [(i, float(i % 12), 1000.0 * (i // 12)) for i in range(24)]
    g = Graph(spark.createDataFrame(v, "id long, x double, y double"), spark.createDataFrame([], "eid long, src long, dst long, length double"))
    rows = connectivity.connect(g).collect()
    assert len(rows) == 23 and sorted(r["length"] for r in rows)[:22] == [1.5] * 22
    assert max(r["length"] for r in rows) == pytest.approx(1000 * 1.5 * 2)
    assert max(r["length"] for r in connectivity.connect(g, chain_above=1).collect()) == pytest.approx(3000)
    whole = connectivity.connected(g)
    assert connectivity.components(whole.vertices, whole.edges).select("component").distinct().count() == 1
    assert whole.edges.where("type = 'virtual'").select("eid").distinct().count() == 23
    far = Graph(spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 1.0)], "id long, lon double, lat double"), g.edges.drop("length"))
    assert connectivity.connect(far).first()["length"] == pytest.approx(111_000 * 1.5)
    assert connectivity.connect(Graph(far.vertices.select("id"), far.edges)).count() == 0


def test_both_ways_of_searching_agree(spark):
    rng = random.Random(3)
    v = spark.createDataFrame([(i,) for i in range(60)], "id long")
    e = spark.createDataFrame([(i, rng.randrange(50), rng.randrange(50), float(rng.randint(1, 9))) for i in range(70)], "eid long, src long, dst long, length double")
    g, s = Graph(v, e), spark.createDataFrame([(0, 3), (1, 17), (2, 55)], "pos long, id long")
    near = [sorted(map(tuple, distances.nearest_center(g, s, small=n).collect()), key=str) for n in (1000, 0)]
    assert near[0] == near[1] and len(near[0]) == 60
    paths = [sorted(map(tuple, distances.shortest_paths(g, s, small=n).collect())) for n in (1000, 0)]
    assert paths[0] == paths[1]
    degree = v.withColumn("degree", F.lit(1))
    first = [[r["id"] for r in samplers.farthest_first(g, 4, degree, small=n).orderBy("pos").collect()] for n in (1000, 0)]
    assert first[0] == first[1]
    two = s.withColumn("run", F.col("pos") % 2)
    runs = [sorted(map(tuple, distances.nearest_center(g, two, ("run",), small=n).collect()), key=str) for n in (1000, 0)]
    assert runs[0] == runs[1] and len(runs[0]) == 120


def test_search_by_blocks(spark, monkeypatch):
    """A path that winds through all blocks, side roads, copies of a place and vertices without one: as by Dijkstra over the whole, in few rounds."""
    monkeypatch.setattr(distances, "BLOCK_EDGES", 24)
    rng = random.Random(5)
    place = [(float(i // 10), float(i % 10 if i // 10 % 2 == 0 else 9 - i % 10)) for i in range(100)] + [(2.0, 2.0)] * 90 + [(None, 1.0), (math.nan, 0.0), (math.inf, 0.0)]
    ends = [(i, i + 1) for i in range(99)] + [(rng.randrange(100), i) for i in range(100, 193)] + [(rng.randrange(193), rng.randrange(193)) for _ in range(15)]
    rows = [(i, a, b, float(rng.randint(1, 4))) for i, (a, b) in enumerate(ends)] + [(999, 0, 150, None)]
    v = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([*place, (0.0, 0.0)])], "id long, x double, y double")
    e = spark.createDataFrame(rows, "eid long, src long, dst long, length double")
    g, known = Graph(v, e), Graph(v.select("id"), e.where("length IS NOT NULL"))
    s = spark.createDataFrame([(0, 0), (1, 150), (2, 193)], "pos long, id long")
    made, rounds = distances.stored, []
    monkeypatch.setattr(distances, "stored", lambda df, name="round": rounds.append(name) or made(df, name))
    want = sorted(map(tuple, distances.nearest_center(known, s).collect()), key=str)
    for graph in (g, known):
        rounds.clear()
        assert sorted(map(tuple, distances.nearest_center(graph, s, small=0).collect()), key=str) == want
        assert rounds.count("relax") == 0 and 2 < rounds.count("entries") < 40  # a round for each step would be over 90 for the path alone
    assert distances.Blocks(g).block.select("block").distinct().count() > 5
    paths = [sorted(map(tuple, distances.shortest_paths(x, s, small=n).collect())) for x, n in ((known, 1000), (g, 0))]
    assert paths[0] == paths[1]
    degree = v.select("id", F.lit(1).alias("degree"))
    first = [[r["id"] for r in samplers.farthest_first(x, 5, degree, small=n).orderBy("pos").collect()] for x, n in ((known, 1000), (g, 0))]
    assert first[0] == first[1]


def test_top_communities(spark):
    v = spark.createDataFrame([(i, c) for i, c in enumerate([0] * 5 + [1] * 3 + [2] * 3 + [3])], "id long, community long")
    assert {r["community"] for r in communities.top_communities(v, 2).collect()} == {0, 1, -1}


def test_round_robin_resets(spark):
    v = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (9, 1)], "id long, community long")
    order = spark.createDataFrame([(0, 0), (1, 1)], "city_pos long, community long")
    got = [r["id"] for r in samplers.round_robin(v, 6, 1, order).orderBy("pos").collect()]
    assert got[1] == 9 and got[5] == 9 and set(got[:4]) == {1, 2, 3, 9}


def test_package_round_trip(spark, roads, tmp_path):
    write_graph(roads, str(tmp_path / "g"))
    again = read_graph(spark, str(tmp_path / "g"))
    assert again.edges.count() == 6 and induced(again, again.vertices.where("id < 3")).edges.count() == 3
    with pytest.raises(ValueError, match="missing edge column"):
        again.validate(edge=("absent",))
    assert seeds_folder([1, 2]) == "seed_1_2" and seeds_folder(list(range(100, 130))) == "seeds_100_to_129"


def test_results_document(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "algo string, k long, cov double")
    write_results(rows, str(tmp_path / "r"), "json", {"seed": 7})
    found = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()))
    assert found["meta"] == {"seed": 7} and sorted(r["algo"] for r in found["rows"]) == ["a", "b"]
