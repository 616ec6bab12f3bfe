"""The same results in DuckDB's SQL."""

from __future__ import annotations

from geosieve.operators.experiment import ALGORITHMS
from geosieve.operators.metrics import DRAWN, MEASURES
from geosieve.operators.scoring import PARTS, PRINCIPAL, RANGES

_FAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
EMB = f"""ev AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS community FROM embeddings),
ee AS (SELECT src * 3 + r - 1 AS eid, src, dst, length FROM (SELECT a.id AS src, b.id AS dst, {_FAR} AS length, row_number() OVER (PARTITION BY a.id ORDER BY {_FAR}, b.id) AS r FROM ev a JOIN ev b ON a.id <> b.id) WHERE r <= 3),
und AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(length) AS length FROM ee GROUP BY 1, 2),
sym AS (SELECT a AS src, b AS dst, length FROM und UNION ALL SELECT b, a, length FROM und),
deg AS (SELECT id, count(e.id) AS degree FROM ev LEFT JOIN (SELECT src AS id FROM ee UNION ALL SELECT dst FROM ee) e USING (id) GROUP BY id)"""
EVT = """te AS (SELECT event_id AS eid, src, user_id AS dst, value AS length, highway, maxspeed FROM (SELECT *, lag(user_id) OVER (ORDER BY ts, event_id) AS src,
 CASE event_type WHEN 'click' THEN 'residential' WHEN 'view' THEN 'service' WHEN 'purchase' THEN 'primary' WHEN 'signup' THEN 'motorway' END AS highway,
 CASE event_type WHEN 'signup' THEN 'signals' WHEN 'view' THEN k || ' mph' ELSE k END AS maxspeed FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)) WHERE src IS NOT NULL),
ts AS (SELECT *, CASE WHEN lower(trim(maxspeed)) NOT IN ('none', 'signals', 'variable', 'walk') THEN TRY_CAST(nullif(regexp_extract(lower(trim(maxspeed)), '(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) END AS kph,
 CASE WHEN highway IN ('residential', 'primary', 'motorway', 'service') THEN highway ELSE 'other' END AS cls FROM te),
tv AS (SELECT DISTINCT user_id AS id FROM events),
inc AS (SELECT src AS id, dst AS other, length, kph, cls FROM ts UNION ALL SELECT dst, src, length, kph, cls FROM ts),
tagf AS (SELECT id, coalesce(avg((cls = 'residential')::INT), 0) AS freq_residential, coalesce(avg((cls = 'primary')::INT), 0) AS freq_primary, coalesce(avg((cls = 'motorway')::INT), 0) AS freq_motorway, coalesce(avg((cls = 'service')::INT), 0) AS freq_service, coalesce(avg((cls = 'other')::INT), 0) AS freq_other, coalesce(avg(kph), 0) AS avg_maxspeed, count(cls) AS degree, coalesce(avg(length), 0) AS avg_edge_len_all FROM tv LEFT JOIN inc USING (id) GROUP BY id),
outl AS (SELECT id, coalesce(avg(length), 0) AS avg_edge_len FROM tv LEFT JOIN (SELECT src AS id, length FROM ts) USING (id) GROUP BY id),
nb AS (SELECT DISTINCT id, other FROM inc WHERE id <> other),
nd AS (SELECT id, count(*) AS d FROM nb GROUP BY id),
tri AS (SELECT p.id, count(*) AS t FROM nb p JOIN nb q ON p.id = q.id AND p.other < q.other JOIN nb r ON r.id = p.other AND r.other = q.other GROUP BY p.id),
clus AS (SELECT id, CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS clustering_coeff FROM tv LEFT JOIN nd USING (id) LEFT JOIN tri USING (id)),
feat AS (SELECT id, freq_residential, freq_primary, freq_motorway, freq_service, freq_other, avg_maxspeed, degree, avg_edge_len, clustering_coeff FROM tagf JOIN outl USING (id) JOIN clus USING (id)),
m0 AS (SELECT id, ln(1 + degree) AS log_degree, clustering_coeff AS clustering, freq_residential, avg_edge_len, freq_motorway, avg_maxspeed FROM feat),
mat AS (SELECT id, log_degree, clustering, freq_residential, least(avg_edge_len, (SELECT quantile_cont(avg_edge_len, 0.995) FROM m0)) AS avg_edge_len, freq_motorway, least(avg_maxspeed, (SELECT quantile_cont(avg_maxspeed, 0.995) FROM m0)) AS avg_maxspeed FROM m0)"""
_F = ("log_degree", "clustering", "freq_residential", "avg_edge_len", "freq_motorway", "avg_maxspeed")
_Z = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in _F)
EVT += f",\nz AS (SELECT id, {_Z} FROM mat)"
_W = {"log_degree": 0.6, "clustering": 0.3, "freq_residential": 0.4, "avg_edge_len": -0.3, "freq_motorway": -0.4, "avg_maxspeed": -0.2}


def _rr(pool: str, k: int, seed: int, place: str, also: str = "") -> str:
    """Round robin as windows; `place` orders communities in a cycle c.cycle."""
    return f"""pool AS ({pool}), cyc AS (SELECT unnest(range(0, CAST(ceil({k} * 1.0 / (SELECT count(*) FROM pool)) AS BIGINT))) AS cycle),
rr AS (SELECT pool.*, cycle, row_number() OVER (PARTITION BY cycle, community ORDER BY md5('{seed}:' || cycle || ':' || id), id) AS r FROM pool, cyc),
sample AS (SELECT row_number() OVER (ORDER BY cycle, r, {place}) - 1 AS pos, id FROM rr{also} QUALIFY pos < {k})"""


def _drawn(seed: int) -> str:
    return f"md5('{seed}:' || cycle || ':c:' || community), community"


_POOL = "SELECT id, community FROM ev WHERE community <> -1"
_REPS = "reps AS (SELECT community, id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 12), id) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY community) AS mx, avg(y) OVER (PARTITION BY community) AS my FROM ev)) WHERE n = 1)"
_SAMPLE = _rr(_POOL, 25, 7, _drawn(7)) + ", s AS (SELECT pos, id FROM sample)"
_COMP = "comp AS (WITH RECURSIVE r(id, component) USING KEY (id) AS (SELECT id, id FROM ev UNION SELECT e.dst, min(r.component) FROM r JOIN sym e ON e.src = r.id JOIN recurring.r o ON o.id = e.dst WHERE r.component < o.component GROUP BY e.dst) SELECT * FROM r)"


def _paths(source: str) -> str:
    """Distances (s, id, d) from each source."""
    return f"pth AS (WITH RECURSIVE r(s, id, d) USING KEY (s, id) AS (SELECT id, id, 0::DOUBLE FROM ({source}) UNION SELECT r.s, e.dst, min(r.d + e.length) FROM r JOIN sym e ON e.src = r.id LEFT JOIN recurring.r o ON o.s = r.s AND o.id = e.dst WHERE o.d IS NULL OR r.d + e.length < o.d GROUP BY r.s, e.dst) SELECT * FROM r)"


_NEAR = _SAMPLE + ", " + _paths("SELECT id FROM s") + ", nc AS (SELECT ev.id, min(pth.d) AS d, coalesce(arg_min(s.pos, (pth.d, s.pos)), -1) AS owner FROM ev LEFT JOIN pth ON pth.id = ev.id LEFT JOIN s ON s.id = pth.s GROUP BY ev.id)"
_COUNTS = "cnt AS (SELECT community, count(*) AS n FROM ev JOIN s USING (id) WHERE community <> -1 GROUP BY 1)"
_BAL = "round(stddev_pop(n) / avg(n), 6) AS balance_cv, round(CASE WHEN count(*) = 1 THEN 1 ELSE (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) END, 6) AS balance_entropy"


_TOP = "SELECT community FROM {} WHERE community <> -1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4"
_PRUNED = EMB.replace("ev AS (", "evf AS (", 1).replace("ee AS (", "eef AS (", 1).replace("FROM ev a JOIN ev b", "FROM evf a JOIN evf b").replace("und AS (", f"ev AS (SELECT * FROM evf WHERE community IN ({_TOP.format('evf')})),\nee AS (SELECT * FROM eef WHERE src IN (SELECT id FROM ev) AND dst IN (SELECT id FROM ev)),\nund AS (", 1)


def pruned(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_PRUNED, *more]) + "\n" + body


def emb(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([EMB, *more]) + "\n" + body


def evt(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([EVT, *more]) + "\n" + body


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


_CREPS = "reps AS (SELECT community, id, x, y, degree FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS n FROM ev JOIN deg USING (id) WHERE community <> -1) WHERE n = 1)"


def _farthest(pool: str, matrix: str, k: str) -> str:
    """fo (step, id): farthest-first over a pool (id, degree) and distances (a, b, d); what isn't reached is farthest."""
    return f"""fp AS ({pool}), fm AS ({matrix}), fr AS (WITH RECURSIVE o(step, ids) AS (SELECT 0, [arg_max(id, (degree, -id))] FROM fp UNION ALL
 SELECT step + 1, list_append(ids, arg_max(id, (near, -id))) FROM (SELECT o.step, o.ids, c.id, min(coalesce(m.d, 'inf'::DOUBLE)) AS near FROM o, unnest(o.ids) AS u(f), fp c LEFT JOIN fm m ON m.a = u.f AND m.b = c.id WHERE NOT list_contains(o.ids, c.id) AND o.step + 1 < {k} GROUP BY ALL) GROUP BY step, ids)
 SELECT * FROM o), fo AS (SELECT len(ids) - 1 AS step, ids[len(ids)] AS id FROM fr)"""


_RING = f"SELECT a.id AS a, b.id AS b, {_FAR} AS d FROM reps a JOIN reps b ON a.id <> b.id"
_ALL = "SELECT s AS a, id AS b, d FROM pth"
_SCORE = " + ".join(f"{c} * {w}::DOUBLE" for c, w in _W.items())
_NORMAL = "p{0} / sqrt(v{0}) * exp(-(u - m{0}) * (u - m{0}) / (2 * v{0}))"
_POSTERIOR = f"CASE WHEN {_NORMAL.format(0)} + {_NORMAL.format(1)} > 0 THEN {_NORMAL.format(1)} / ({_NORMAL.format(0)} + {_NORMAL.format(1)}) ELSE (abs(u - m1) < abs(u - m0))::INT END"
#: kept (id, urbanity_score, p_urban): expectation-maximisation, one recursion a round.
_MIXTURE = f"""us AS MATERIALIZED (SELECT id, {_SCORE} AS u FROM z),
em AS (WITH RECURSIVE r(i, m0, m1, v0, v1, p0, p1, moved) AS (
 SELECT 0, quantile_cont(u, 0.25), quantile_cont(u, 0.75), greatest(var_pop(u), 1e-9), greatest(var_pop(u), 1e-9), 0.5::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE FROM us
 UNION ALL
 SELECT i + 1, a0, a1, greatest((t - t1) / (n - n1) - a0 * a0, 1e-9), greatest(t1 / n1 - a1 * a1, 1e-9), (n - n1) / n, n1 / n, greatest(abs(a0 - m0), abs(a1 - m1)) FROM (
  SELECT *, (s - s1) / (n - n1) AS a0, s1 / n1 AS a1 FROM (
   SELECT i, m0, m1, sum(p) AS n1, sum(p * u) AS s1, sum(p * u * u) AS t1, count(u) AS n, sum(u) AS s, sum(u * u) AS t
   FROM (SELECT r.*, u, {_POSTERIOR} AS p FROM r, us WHERE i < 200 AND moved >= 1e-6) GROUP BY i, m0, m1)
  WHERE least(n - n1, n1) >= 1e-9))
 SELECT * FROM r ORDER BY i DESC LIMIT 1),
kept AS (SELECT * FROM (SELECT id, u AS urbanity_score, CASE WHEN m1 >= m0 THEN p ELSE 1 - p END AS p_urban FROM (SELECT id, u, m0, m1, {_POSTERIOR} AS p FROM us, em)) WHERE p_urban >= 0.5)"""


def _principal(rounds: int = 3000) -> str:
    """ps (id, urbanity_score): power iteration on the covariances of the z-scores, then the sign of degree."""
    c, every = PRINCIPAL, range(len(PRINCIPAL))
    z = ", ".join(f"({x} - avg({x}) OVER ()) / coalesce(nullif(stddev_pop({x}) OVER (), 0), 1) AS {x}" for x in c)
    shared = ", ".join(f"covar_pop({c[i]}, {c[j]}) AS c_{i}_{j}" for i in every for j in every)
    turned = ", ".join(" + ".join(f"c_{i}_{j} * w_{j}" for j in every) + f" AS y_{i}" for i in every)
    size = "sqrt(" + " + ".join(f"y_{i} * y_{i}" for i in every) + ")"
    names = ", ".join(f"w_{i}" for i in every)
    first = ", ".join(f"{1 + i / 7:.6f}::DOUBLE" for i in every)
    score = " + ".join(f"{c[i]} * w_{i}" for i in every)
    return f"""pf AS MATERIALIZED (SELECT id, {z} FROM (SELECT feat.* REPLACE (avg_edge_len_all AS avg_edge_len), 0.0::DOUBLE AS betweenness FROM feat JOIN (SELECT id, avg_edge_len_all FROM tagf) USING (id))),
pc AS MATERIALIZED (SELECT {shared} FROM pf),
pw AS (WITH RECURSIVE r(n, {names}) AS (SELECT 0, {first} UNION ALL SELECT n + 1, {", ".join(f"y_{i} / {size}" for i in every)} FROM (SELECT n, {turned} FROM r, pc WHERE n < {rounds})) SELECT * FROM r ORDER BY n DESC LIMIT 1),
ps AS (SELECT id, ({score}) * CASE WHEN w_0 < 0 THEN -1 ELSE 1 END AS urbanity_score FROM pf, pw)"""


_CORES = f"near AS (SELECT a.id AS a, b.id AS b FROM ev a JOIN ev b ON {_FAR} <= (SELECT knee FROM kk)), core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 10), cl AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)), lab AS (WITH RECURSIVE r(id, label) USING KEY (id) AS (SELECT id, id FROM core UNION SELECT e.b, min(r.label) FROM r JOIN cl e ON e.a = r.id JOIN recurring.r o ON o.id = e.b WHERE r.label < o.label GROUP BY e.b) SELECT * FROM r)"
def _trials(n: int) -> str:
    """tj (trial, objective, d_<feature>, w_<feature>) of n drawn weight vectors."""
    raw = ", ".join(f"{a}::DOUBLE + ({b}::DOUBLE - {a}::DOUBLE) * (('0x' || md5('7:' || trial || ':{c}')[1:8])::BIGINT / 4294967296.0::DOUBLE) AS w_{c}" for c, (a, b) in RANGES.items())
    unit = ", ".join(f"w_{c} / (sqrt(" + " + ".join(f"w_{x} * w_{x}" for x in _F) + f") + 1e-8::DOUBLE) AS w_{c}" for c in _F)
    delta = ", ".join(f"avg({c}) FILTER (s >= hi) - avg({c}) FILTER (s <= lo) AS d_{c}" for c in _F)
    score = " + ".join(f"{c} * w_{c}" for c in _F)
    total = " + ".join(f"({sign}::DOUBLE * d_{c} - {penalty}::DOUBLE * (d_{c} {'<' if sign > 0 else '>'} 0)::INT)" for c, (sign, penalty) in PARTS.items())
    return f"""tw AS MATERIALIZED (SELECT trial, {unit} FROM (SELECT trial, {raw} FROM range({n}) t(trial))), sc AS MATERIALIZED (SELECT trial, {", ".join(_F)}, {score} AS s FROM z, tw),
ct AS (SELECT trial, quantile_cont(s, 0.2) AS lo, quantile_cont(s, 0.8) AS hi FROM sc GROUP BY trial), dl AS (SELECT trial, {delta} FROM sc JOIN ct USING (trial) GROUP BY trial),
tj AS (SELECT *, {total} AS objective FROM dl JOIN tw USING (trial))"""




def _forest(edges: str) -> str:
    """mst (a, b, weight): edges between whose ends no path of lesser ones (weight, a, b) leads."""
    return f"""me AS MATERIALIZED ({edges}), ms AS (SELECT a AS src, b AS dst, a, b, weight FROM me UNION ALL SELECT b, a, a, b, weight FROM me),
mr AS (WITH RECURSIVE r(a, b, weight, id) AS (SELECT a, b, weight, a FROM me UNION SELECT r.a, r.b, r.weight, ms.dst FROM r JOIN ms ON ms.src = r.id WHERE (ms.weight, ms.a, ms.b) < (r.weight, r.a, r.b)) SELECT * FROM r),
mst AS (SELECT a, b, weight FROM me WHERE NOT EXISTS (SELECT 1 FROM mr WHERE mr.a = me.a AND mr.b = me.b AND mr.id = me.b))"""


_PLACED = "reps AS (SELECT component, id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 12), id) AS n FROM (SELECT id, x, y, component, avg(x) OVER (PARTITION BY component) AS mx, avg(y) OVER (PARTITION BY component) AS my FROM ev JOIN comp USING (id))) WHERE n = 1)"


def _samples(algorithms: tuple[str, ...] = tuple(ALGORITHMS), ks: tuple[int, ...] = (10, 20), repeats: int = 2, first: int = 7) -> str:
    """sam (algo, k, repeat, pos, id), and what each sample is worth: runs."""
    order = "SELECT ev.id, community, step AS city_pos FROM ev JOIN (SELECT step, community FROM co JOIN reps USING (id)) USING (community) WHERE step < {k}"
    parts = []
    for repeat in range(repeats):
        seed = first + repeat
        for k in ks:
            of = {
                "full_random": f"SELECT row_number() OVER (ORDER BY md5('{seed}:' || id), id) - 1 AS pos, id FROM evf QUALIFY pos < {k}",
                "pruned_random": f"SELECT row_number() OVER (ORDER BY md5('{seed}:' || id), id) - 1 AS pos, id FROM ev QUALIFY pos < {k}",
                "round_robin": "WITH " + _rr(_POOL, max(ks), seed, _drawn(seed)) + f" SELECT pos, id FROM sample WHERE pos < {k}",
                "fft": f"SELECT step AS pos, id FROM fo WHERE step < {k}",
                "hybrid": "WITH " + _rr(order.format(k=k), k, seed, "city_pos") + " SELECT pos, id FROM sample",
            }
            parts += [f"SELECT '{ALGORITHMS[a]}' AS algo, {k}::BIGINT AS k, {repeat}::BIGINT AS repeat, pos, id FROM ({of[a]})" for a in algorithms]
    cities = _farthest("SELECT id, degree FROM reps", _RING, "(SELECT count(*) FROM fp)").replace("fp AS (", "cp AS (", 1).replace("fm AS (", "cm AS (", 1).replace("fr AS (", "cr AS (", 1).replace("fo AS (", "co AS (", 1)
    cities = cities.replace("FROM fp)", "FROM cp)").replace("FROM fp ", "FROM cp ").replace(", fp c ", ", cp c ").replace("JOIN fm ", "JOIN cm ").replace("FROM fr)", "FROM cr)")
    key = "algo, k, repeat"
    full = f"'{ALGORITHMS['full_random']}'"
    return ",\n".join([
        _paths("SELECT id FROM ev"), _farthest("SELECT id, degree FROM deg", _ALL, str(max(ks))), _CREPS, cities,
        "sam AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")",
        f"ins AS (SELECT {key}, id, min(pos) AS pos FROM sam WHERE id IN (SELECT id FROM ev) GROUP BY ALL)",
        f"rc AS (SELECT {key}, ev.community, count(*) AS n FROM ins JOIN ev USING (id) WHERE ev.community <> -1 GROUP BY ALL)",
        f"rb AS (SELECT {key}, count(*) AS got, stddev_pop(n) / avg(n) AS balance_cv, CASE WHEN count(*) = 1 THEN 1 ELSE (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) END AS balance_entropy FROM rc GROUP BY ALL)",
        f"rd AS (SELECT {key}, pth.id, min(d) AS d FROM ins JOIN pth ON pth.s = ins.id GROUP BY ALL)",
        f"rn AS (SELECT {key}, id, coalesce(d, 10 * max(d) OVER (PARTITION BY {key})) AS f FROM (SELECT DISTINCT {key} FROM ins) CROSS JOIN (SELECT id FROM ev) LEFT JOIN rd USING ({key}, id))",
        f"rg AS (SELECT {key}, max(f) AS global_R_max, avg(f) AS global_mean, quantile_cont(f, 0.5) AS global_median, quantile_cont(f, 0.9) AS global_p90 FROM rn GROUP BY ALL)",
        f"rp AS (SELECT {key}, coalesce(d, 10 * coalesce(max(d) OVER (PARTITION BY {key}), 1)) AS f FROM (SELECT p.algo, p.k, p.repeat, p.id AS a, q.id AS b FROM ins p JOIN ins q ON p.algo = q.algo AND p.k = q.k AND p.repeat = q.repeat AND p.pos < q.pos) LEFT JOIN pth ON pth.s = a AND pth.id = b)",
        f"rv AS (SELECT {key}, min(f) AS div_min_sep, avg(f) AS div_mean, quantile_cont(f, 0.5) AS div_median, quantile_cont(f, 0.1) AS div_p10, quantile_cont(f, 0.9) AS div_p90 FROM rp GROUP BY ALL)",
        f"re AS (SELECT {key}, count(*) AS k_eff FROM ins GROUP BY ALL)",
        f"runs AS (SELECT {key}, repeat + {first} AS seed, k_eff, CASE WHEN algo = {full} THEN k_eff / k::DOUBLE ELSE 1 END AS efficiency, got / (SELECT count(DISTINCT community) FROM ev)::DOUBLE AS cov, rb.* EXCLUDE ({key}, got), rg.* EXCLUDE ({key}), rv.* EXCLUDE ({key}) FROM re JOIN rb USING ({key}) JOIN rg USING ({key}) JOIN rv USING ({key}))",
        "agg AS (SELECT algo, k, " + ", ".join(f"avg({m}) AS {m}_mean, coalesce(stddev_pop({m}), 0) AS {m}_std" for m in MEASURES) + " FROM runs GROUP BY algo, k)",
    ])


#: kn (id, d): distances to the tenth nearest, each vertex its own first; kk: their knee.
_KTH = f"kn AS (SELECT a AS id, max(d) AS d FROM (SELECT a.id AS a, b.id AS b, {_FAR} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_FAR}, b.id) AS r FROM ev a JOIN ev b ON a.id <> b.id) WHERE r <= 9 GROUP BY 1)"
_KNEE = "kk AS (SELECT arg_max(d, (round(abs(n * (d - y0) - i * (y1 - y0)), 9), -i)) AS knee FROM (SELECT d, (row_number() OVER (ORDER BY d, id) - 1)::DOUBLE AS i, count(*) OVER () - 1 AS n, min(d) OVER () AS y0, max(d) OVER () AS y1 FROM kn))"
_ROADS = """rn AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(length) AS length FROM ee WHERE eid % 3 = 0 GROUP BY 1, 2),
rd AS (SELECT (a * 1000000 + b) * 2 AS eid, a AS src, b AS dst, length FROM rn UNION ALL SELECT (a * 1000000 + b) * 2 + 1, b, a, length FROM rn WHERE a % 5 <> 0),
en AS (SELECT src AS id, dst AS other, 1 AS o FROM rd UNION ALL SELECT dst, src, 0 FROM rd),
inn AS (SELECT id FROM en GROUP BY id HAVING count(DISTINCT other) = 2 AND max((other = id)::INT) = 0 AND ((count(*) = 2 AND sum(o) = 1) OR (count(*) = 4 AND count(DISTINCT (other, o)) = 4))),
nxt AS (SELECT u.eid AS a, v.eid AS b FROM rd u JOIN rd v ON u.dst = v.src AND u.src <> v.dst WHERE u.dst IN (FROM inn)),
lnk AS (SELECT a, b FROM nxt UNION ALL SELECT b, a FROM nxt),
chn AS (WITH RECURSIVE r(eid, chain) USING KEY (eid) AS (SELECT eid, eid FROM rd UNION SELECT l.b, min(r.chain) FROM r JOIN lnk l ON l.a = r.eid JOIN recurring.r o ON o.eid = l.b WHERE r.chain < o.chain GROUP BY l.b) SELECT * FROM r),
who AS (SELECT chain, min(CASE WHEN src NOT IN (FROM inn) THEN src END) AS src, min(CASE WHEN dst NOT IN (FROM inn) THEN dst END) AS dst, sum(length) AS length, count(*) AS parts FROM rd JOIN chn USING (eid) GROUP BY chain)"""


ORACLES: dict[str, str] = {
    "edge_speeds": evt("SELECT eid, round(coalesce(kph, avg(kph) OVER (PARTITION BY highway), avg(kph) OVER ()), 6) AS speed_kph FROM ts"),
    "edge_travel_times": evt("SELECT eid, round(length / 1000 / nullif(coalesce(kph, avg(kph) OVER (PARTITION BY highway), avg(kph) OVER ()), 0) * 3600, 6) AS travel_time FROM ts"),
    "flatten_tags": evt("SELECT src, coalesce(string_agg(DISTINCT highway, ',' ORDER BY highway), '') AS highway FROM ts GROUP BY src"),
    "dense_ids": emb("SELECT id AS osmid, row_number() OVER (ORDER BY id) - 1 AS idx FROM ev"),
    "active_nodes": evt("SELECT id FROM tv WHERE id IN (SELECT id FROM inc)"),
    "highway_filter": evt("SELECT eid, src, dst, highway FROM ts WHERE highway IN ('primary', 'motorway')"),
    "undirected_collapse": emb("SELECT a, b, round(length, 6) AS length FROM und"),
    "induced_subgraph": emb("SELECT eid, src, dst, round(length, 6) AS length FROM ee WHERE src IN (SELECT id FROM ev WHERE community < 3) AND dst IN (SELECT id FROM ev WHERE community < 3)"),
    "map_and_dedup": emb("SELECT row_number() OVER (ORDER BY f) - 1 AS pos, id FROM (SELECT id, min(pos) AS f FROM sample JOIN ev USING (id) WHERE community IN (" + _TOP.format("ev") + ") GROUP BY id)", _rr(_POOL, 3000, 7, _drawn(7))),
    "parse_speeds": evt("SELECT eid, kph FROM ts"),
    "tag_features": evt("SELECT id, degree, " + _r("freq_residential", "freq_primary", "freq_motorway", "freq_service", "freq_other", "avg_maxspeed") + " FROM tagf"),
    "avg_edge_len": evt("SELECT id, " + _r("avg_edge_len") + " FROM outl"),
    "clustering_coeff": emb("SELECT ev.id, round(CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering_coeff FROM ev LEFT JOIN nd ON nd.id = ev.id LEFT JOIN tri ON tri.id = ev.id", "nd AS (SELECT src AS id, count(*) AS d FROM sym GROUP BY 1)", "tri AS (SELECT p.src AS id, count(*) AS t FROM sym p JOIN sym q ON p.src = q.src AND p.dst < q.dst JOIN sym r ON r.src = p.dst AND r.dst = q.dst GROUP BY 1)"),
    "node_features": evt("SELECT id, degree, " + _r("freq_residential", "freq_primary", "freq_motorway", "freq_service", "freq_other", "avg_maxspeed", "avg_edge_len", "clustering_coeff") + " FROM feat"),
    "tag_freq_pivot": evt("SELECT id, " + _r("freq_residential", "freq_primary", "freq_motorway", "freq_service", "freq_other") + " FROM tagf WHERE degree > 0"),
    "feature_matrix": evt("SELECT id, " + _r(*_F) + " FROM mat"),
    "gmm_prune": evt("SELECT id, " + _r("urbanity_score", "p_urban") + " FROM kept", _MIXTURE),
    "urban_prune": evt("SELECT eid, src, dst, round(length, 6) + 0.0 AS length FROM te WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)", _MIXTURE),
    "pca_score": evt("SELECT id, " + _r("urbanity_score") + " FROM ps", _principal()),
    "zscore": evt("SELECT id, " + _r(*_F) + " FROM z"),
    "winsorize": emb("SELECT id, round(least(x, (SELECT quantile_cont(x, 0.9) FROM ev)), 6) AS x FROM ev"),
    "urbanity_score": evt("SELECT id, round(" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in _W.items()) + ", 6) + 0.0 AS urbanity_score FROM z"),
    "det_sample": emb("SELECT id FROM ev ORDER BY md5('7:' || id), id LIMIT 50"),
    "knee_point": emb("SELECT round(knee, 6) AS knee FROM kk", _KTH, _KNEE),
    "kth_nn_distance": emb("SELECT id, round(d, 6) AS d FROM kn", _KTH),
    "rural_prune": emb("SELECT id, community::BIGINT AS label FROM ev WHERE community <> (SELECT community FROM ev WHERE community <> -1 GROUP BY 1 ORDER BY avg(x), 1 LIMIT 1)"),
    "edge_strengths": emb("SELECT eid, round(1 / (length + 1e-6), 6) AS strength FROM ee"),
    "modularity": emb("SELECT round(sum(wc / m - (kc / (2 * m)) * (kc / (2 * m))), 6) AS q FROM (SELECT c, sum(w) AS kc, sum(own) AS wc FROM (SELECT va.community AS c, w, CASE WHEN va.community = vb.community THEN w / 2 ELSE 0 END AS own FROM sw JOIN ev va ON va.id = src JOIN ev vb ON vb.id = dst) GROUP BY c), (SELECT sum(w) / 2 AS m FROM sw)", "sw AS (SELECT src, dst, 1 / (length + 1e-6::DOUBLE) AS w FROM sym)"),
    "partition_summary": emb("SELECT count(*) AS n, min(c) AS min_size, quantile_cont(c, 0.5)::DOUBLE AS median_size, max(c) AS max_size FROM (SELECT count(*) AS c FROM ev GROUP BY community)"),
    "top_n_communities": emb("SELECT id, CASE WHEN community IN (SELECT community FROM ev WHERE community <> -1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) THEN community ELSE -1 END::BIGINT AS community FROM ev"),
    "community_size_stats": emb("SELECT count(*) AS n, round(100 * avg((c = 1)::INT), 6) AS pct_single, round(100 * avg((c = 2)::INT), 6) AS pct_pair FROM (SELECT count(*) AS c FROM ev GROUP BY community)"),
    "smallest_communities": emb("SELECT community::BIGINT AS community, count(*) AS size FROM ev GROUP BY 1 ORDER BY 2, 1 LIMIT 5"),
    "highlight_topk": emb("SELECT id, coalesce(color, -1) AS color FROM ev LEFT JOIN (SELECT community, row_number() OVER (ORDER BY count(*) DESC, community) - 1 AS color FROM ev WHERE community <> -1 GROUP BY 1 QUALIFY color < 3) USING (community)"),
    "connected_components": emb("SELECT id, component FROM comp", _COMP),
    "component_reps": emb("SELECT component, id FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 12), id) AS n FROM (SELECT id, x, y, component, avg(x) OVER (PARTITION BY component) AS mx, avg(y) OVER (PARTITION BY component) AS my FROM ev JOIN comp USING (id))) WHERE n = 1", _COMP),
    "knn_reps": emb(f"SELECT a, b, round(d * 1.5::DOUBLE, 6) AS weight FROM (SELECT a.id AS a, b.id AS b, {_FAR} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_FAR}, b.id) AS n FROM reps a JOIN reps b ON a.id <> b.id) WHERE n < 4", _REPS),
    "mst_edges": emb("SELECT count(*) AS n, round(sum(weight), 6) AS weight FROM mst", _forest("SELECT a, b, length AS weight FROM und WHERE a <> b")),
    # Up to ten components, whose representatives are all near each other's.
    "connect_components": emb("SELECT a AS src, b AS dst, round(weight, 6) AS length, 'virtual' AS type FROM mst", _COMP, _PLACED, _forest(f"SELECT a.id AS a, b.id AS b, {_FAR} * 1.5::DOUBLE AS weight FROM reps a JOIN reps b ON a.id < b.id")),
    "bridge_forest": emb("SELECT a, b, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)) * 1.5::DOUBLE * 2.0::DOUBLE, 6) AS weight FROM (SELECT lag(id) OVER (ORDER BY id) AS a, id AS b, x, y, lag(x) OVER (ORDER BY id) AS px, lag(y) OVER (ORDER BY id) AS py FROM reps) WHERE a IS NOT NULL", _REPS),
    "sssp": emb("SELECT id, round(d, 6) AS d FROM pth", _paths("SELECT id FROM ev WHERE id = 0")),
    "pairwise_distances": emb("SELECT s AS source, id, round(d, 6) AS d FROM pth", _CREPS, _paths("SELECT id FROM reps")),
    "replace_infinite": emb("SELECT ev.id, round(coalesce(d, 10 * (SELECT max(d) FROM pth)), 6) AS d FROM ev LEFT JOIN pth ON pth.id = ev.id", _paths("SELECT id FROM ev WHERE id = 0")),
    "euclid_matrix": emb(f"SELECT a.id AS a, b.id AS b, round({_FAR}, 6) AS d FROM reps a JOIN reps b ON a.id <> b.id", _REPS),
    "community_reps": emb("SELECT community::BIGINT AS community, id, degree FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS n FROM ev JOIN deg USING (id) WHERE community <> -1) WHERE n = 1"),
    "round_robin": emb("SELECT pos, id FROM sample", _rr(_POOL, 25, 7, _drawn(7))),
    "round_robin_reset": emb("SELECT pos, id FROM sample", _rr(_POOL, 3000, 7, _drawn(7))),
    "random_full": emb("SELECT row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS pos, id FROM ev QUALIFY pos < 25"),
    "random_pruned": emb("SELECT row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS pos, id FROM ev WHERE community IN (" + _TOP.format("ev") + ") QUALIFY pos < 25"),
    "nearest_center": emb("SELECT id, round(d, 6) AS d, owner FROM nc", _NEAR),
    "global_coverage": emb("SELECT round(max(f), 6) AS global_R_max, round(avg(f), 6) AS global_mean, round(quantile_cont(f, 0.5), 6) AS global_median, round(quantile_cont(f, 0.9), 6) AS global_p90 FROM (SELECT coalesce(d, 10 * max(d) OVER ()) AS f FROM nc)", _NEAR),
    "diversity": emb("SELECT round(min(f), 6) AS div_min_sep, round(avg(f), 6) AS div_mean, round(quantile_cont(f, 0.5), 6) AS div_median, round(quantile_cont(f, 0.1), 6) AS div_p10, round(quantile_cont(f, 0.9), 6) AS div_p90 FROM (SELECT coalesce(d, 10 * max(d) OVER ()) AS f FROM s p JOIN s q ON p.pos < q.pos LEFT JOIN pth ON pth.s = p.id AND pth.id = q.id)", _NEAR),
    "community_coverage": emb("SELECT (SELECT count(DISTINCT community) FROM ev WHERE community <> -1) AS n_comm_full, count(*) AS n_comm_repr, round(count(*) / (SELECT count(DISTINCT community) FROM ev WHERE community <> -1)::DOUBLE, 6) AS cov FROM cnt", _SAMPLE, _COUNTS),
    "balance": emb(f"SELECT {_BAL} FROM cnt", _SAMPLE, _COUNTS),
    "ari_nmi": emb("SELECT round((t2 - a2 * b2 / (n * (n - 1) / 2)) / ((a2 + b2) / 2 - a2 * b2 / (n * (n - 1) / 2)), 6) AS ari, round((tl / n - al / n - bl / n + ln(n)) / ((ln(n) - al / n + ln(n) - bl / n) / 2), 6) AS nmi FROM (SELECT sum(c * (c - 1) / 2) AS t2, sum(c * ln(c)) AS tl, sum(c) AS n FROM tab), (SELECT sum(c * (c - 1) / 2) AS a2, sum(c * ln(c)) AS al FROM (SELECT sum(c)::DOUBLE AS c FROM tab GROUP BY community)), (SELECT sum(c * (c - 1) / 2) AS b2, sum(c * ln(c)) AS bl FROM (SELECT sum(c)::DOUBLE AS c FROM tab GROUP BY owner))", _NEAR, "tab AS (SELECT community, owner, count(*)::DOUBLE AS c FROM nc JOIN ev USING (id) WHERE owner <> -1 GROUP BY 1, 2)"),
    "efficiency": emb("SELECT count(*) AS k_eff, round(count(*) / 100::DOUBLE, 6) AS efficiency FROM (SELECT id, community FROM ev QUALIFY row_number() OVER (ORDER BY md5('7:' || id), id) <= 100) WHERE community IN (" + _TOP.format("ev") + ")"),
    "compare_grid": pruned("SELECT algo, k, repeat, seed, k_eff, " + _r(*MEASURES) + " FROM runs", _samples()),
    "compare_agg": pruned("SELECT algo, k, " + _r(*(f"{m}_{x}" for m in MEASURES for x in ("mean", "std"))) + " FROM agg", _samples()),
    "plot_series": pruned(" UNION ALL ".join(f"SELECT algo, k, '{m}' AS metric, round({m}_mean, 6) + 0.0 AS mean, round({m}_std, 6) + 0.0 AS std FROM agg" for m in DRAWN), _samples()),
    "fft_nodes": emb("SELECT step::BIGINT AS pos, id FROM fo", _paths("SELECT id FROM ev"), _farthest("SELECT id, degree FROM deg", _ALL, "20")),
    "fft_order_matrix": emb("SELECT step::BIGINT AS city_pos, community::BIGINT AS community FROM fo JOIN reps USING (id)", _CREPS, _farthest("SELECT id, degree FROM reps", _RING, "(SELECT count(*) FROM fp)")),
    "fft_city_order": emb("SELECT step::BIGINT AS city_pos, community::BIGINT AS community FROM fo JOIN reps USING (id)", _CREPS, _paths("SELECT id FROM reps"), _farthest("SELECT id, degree FROM reps", _ALL, "(SELECT count(*) FROM fp)")),
    "fft_city_stream": emb("SELECT step::BIGINT AS city_pos, community::BIGINT AS community FROM fo JOIN reps USING (id)", _CREPS, _paths("SELECT id FROM reps"), _farthest("SELECT id, degree FROM reps", _ALL, "25")),
    "hybrid": emb("SELECT pos, id FROM sample", _CREPS, _farthest("SELECT id, degree FROM reps", _RING, "(SELECT count(*) FROM fp)"), _rr("SELECT ev.id, community, step AS city_pos FROM ev JOIN (SELECT step, community FROM fo JOIN reps USING (id)) USING (community)", 25, 7, "city_pos")),
    "betweenness": emb("SELECT ev.id, coalesce(n, 0)::DOUBLE AS betweenness FROM ev LEFT JOIN (SELECT a.id, count(*) AS n FROM pth a JOIN pth b ON b.s = a.id JOIN pth c ON c.s = a.s AND c.id = b.id WHERE a.s < b.id AND a.id <> a.s AND a.id <> b.id AND abs(a.d + b.d - c.d) <= 1e-9 * c.d GROUP BY a.id) p ON p.id = ev.id", _paths("SELECT id FROM ev")),
    "dbscan": emb("SELECT ev.id, coalesce(lab.label, b.label, -1) AS label FROM ev LEFT JOIN lab ON lab.id = ev.id LEFT JOIN (SELECT near.a AS id, min(label) AS label FROM near JOIN lab ON lab.id = near.b GROUP BY 1) b ON b.id = ev.id", _KTH, _KNEE, _CORES),
    "objective_separation": evt("SELECT trial, " + _r("objective", *(f"d_{c}" for c in _F)) + " FROM tj", _trials(800)),
    "tune_weights": evt("SELECT trial, round(objective, 6) AS objective, " + ", ".join(f"round(w_{c}, 6) AS {c}" for c in _F) + " FROM tj ORDER BY round(objective, 9) DESC, trial LIMIT 1", _trials(800)),
    "round_robin_same_draws": emb("SELECT pos, id FROM sample", _rr(_POOL, 3000, 7, "md5('7:0:c:' || community), community").replace("'7:' || cycle || ':' || id", "'7:0:' || id")),
    "round_robin_with_noise": emb("SELECT pos, id FROM sample", _rr(f"SELECT id, CASE WHEN community IN ({_TOP.format('ev')}) THEN community ELSE -1 END AS community FROM ev", 25, 7, _drawn(7))),
    "compare_two": pruned("SELECT algo, k, repeat, seed, k_eff, " + _r(*MEASURES) + " FROM runs", _samples(("round_robin", "fft"))),
    "knee_point_variant": emb("SELECT CASE WHEN (SELECT min(d) = max(d) FROM kn) THEN 0.5::DOUBLE ELSE round(knee, 6) END AS knee FROM kk", _KTH, _KNEE),
    "simplify_chains": emb("SELECT chain AS eid, src, dst, round(length, 6) AS length, parts FROM who WHERE src IS NOT NULL UNION ALL SELECT eid, rd.src, rd.dst, round(rd.length, 6), 1 FROM rd JOIN chn USING (eid) JOIN who USING (chain) WHERE who.src IS NULL", _ROADS),
    "parse_speeds_legacy": evt("SELECT eid, CASE WHEN lower(maxspeed) NOT IN ('none', 'signals', 'variable', 'implicit') THEN TRY_CAST(nullif(regexp_extract(lower(maxspeed), '(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) END AS kph FROM te"),
    "avg_edge_len_all": evt("SELECT id, round(coalesce(avg(length), 0), 6) + 0.0 AS avg_edge_len FROM tv LEFT JOIN inc USING (id) GROUP BY id"),
    "kept_share": emb("SELECT count(*) FILTER (kept) AS n_kept, round(100 * avg(kept::INT), 6) AS pct_kept FROM (SELECT community IN (" + _TOP.format("ev") + ") AS kept FROM ev)"),
    "highlight_with_noise": emb(f"SELECT id, coalesce(color, -1) AS color FROM v LEFT JOIN (SELECT community, row_number() OVER (ORDER BY count(*) DESC, community) - 1 AS color FROM v GROUP BY 1 QUALIFY color < 3) USING (community)", f"v AS (SELECT id, CASE WHEN community IN ({_TOP.format('ev')}) THEN community ELSE -1 END AS community FROM ev)"),
    "coverage_with_noise": emb("SELECT (SELECT count(DISTINCT community) FROM v) AS n_comm_full, count(DISTINCT community) AS n_comm_repr, round(count(DISTINCT community) / (SELECT count(DISTINCT community) FROM v)::DOUBLE, 6) AS cov FROM v JOIN s USING (id)", _SAMPLE, f"v AS (SELECT id, CASE WHEN community IN ({_TOP.format('ev')}) THEN community ELSE -1 END AS community FROM ev)"),
    "evaluate_empty": emb("SELECT count(DISTINCT community) AS n_comm_full, 0::BIGINT AS n_comm_repr, 0::DOUBLE AS cov, 'nan'::DOUBLE AS balance_cv, 'nan'::DOUBLE AS balance_entropy, 'inf'::DOUBLE AS global_R_max, 'inf'::DOUBLE AS global_mean, 'inf'::DOUBLE AS global_median, 'inf'::DOUBLE AS global_p90, 0::DOUBLE AS div_min_sep, 0::DOUBLE AS div_mean, 0::DOUBLE AS div_median, 0::DOUBLE AS div_p10, 0::DOUBLE AS div_p90, NULL::DOUBLE AS ari, NULL::DOUBLE AS nmi FROM ev WHERE community <> -1"),
}

_PARTS = ("community_coverage", "balance", "global_coverage", "diversity", "ari_nmi")
ORACLES["evaluate_sample"] = "SELECT * FROM " + ", ".join(f"({ORACLES[p]})" for p in _PARTS)
