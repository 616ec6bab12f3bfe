"""Shortest paths, nearest centres, sentinels: in one task for small graphs, block by block for large ones."""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.graph import Graph, symmetric, undirected_min
from geosieve.operators.connectivity import placed
from geosieve.operators.plane import cells
from geosieve.plans.ranks import ranked
from geosieve.plans.storage import forget, stored


#: Undirected edges up to which a graph is sent to the tasks whole (some megabytes), to be searched there by Dijkstra.
SMALL_EDGES = 200_000
#: Undirected edges that a block of a larger graph should hold, entries that are sent to all tasks at most, and entries of a block in one row.
BLOCK_EDGES, SENT_ENTRIES, ROW_ENTRIES = 25_000, 200_000, 500_000


@dataclass
class Net:
    """Neighbours of each vertex: those of ids[i] are far[begins[i] : begins[i + 1]] (places in ids) at `length`."""

    ids: np.ndarray
    begins: np.ndarray
    far: np.ndarray
    length: np.ndarray

    def places(self, ids: list) -> list[int]:
        """Places of those ids that have edges."""
        at = np.searchsorted(self.ids, ids)
        return [int(i) if i < len(self.ids) and self.ids[i] == x else -1 for i, x in zip(at, ids)]

    def reached(self, starts: list[tuple[float, int, int]], most: np.ndarray | None = None) -> dict[int, tuple[float, int]]:
        """Dijkstra from (d, owner, place): the least (d, owner) of each place; with `most`, only what is nearer than that."""
        done: dict[int, tuple[float, int]] = {}
        heap = sorted(starts)
        while heap:
            d, owner, at = heappop(heap)
            if at in done:
                continue
            done[at] = (d, owner)
            a, b = self.begins[at], self.begins[at + 1]
            for to, length in zip(self.far[a:b].tolist(), self.length[a:b].tolist()):
                if to not in done and (most is None or d + length < most[to]):
                    heappush(heap, (d + length, owner, to))
        return done


def _net(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, length: np.ndarray) -> Net:
    """The Net of edges in both directions, whose ends are all in `ids` (sorted)."""
    order = np.lexsort((dst, src))
    return Net(ids, np.append(np.searchsorted(src[order], ids), len(src)), np.searchsorted(ids, dst[order]), length[order])


def small_net(graph: Graph, most: int = SMALL_EDGES) -> Net | None:
    """The graph as a Net if it has at most `most` undirected edges (counted here), else None."""
    one = undirected_min(graph.edges).where("a <> b")
    rows = one.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    a, b, w = (rows[c].to_numpy() for c in ("a", "b", "length"))
    src, dst, length = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    return _net(np.unique(src), src, dst, length)


_BLOCK = "block long, ids array<long>, begins array<long>, far array<long>, length array<double>, out array<long>, to array<long>, there array<long>, beyond array<double>"


def _packed(table):
    """A row for the edges that leave a block's vertices: its own Net, and the edges to other blocks (from place, id, block, length)."""
    import pyarrow as pa

    src, dst, length, own, there = (table[c].to_numpy() for c in ("src", "dst", "length", "block", "there"))
    ids, inner = np.unique(src), own == there
    n = _net(ids, src[inner], dst[inner], length[inner])
    columns = (n.ids, n.begins, n.far, n.length, np.searchsorted(ids, src[~inner]), dst[~inner], there[~inner], length[~inner])
    whole = [pa.array([own[0]], pa.int64())] + [pa.array([c], pa.list_(pa.float64() if i in (3, 7) else pa.int64())) for i, c in enumerate(columns)]
    return pa.table(whole, names=[c.split()[0] for c in _BLOCK.split(", ")])


def _searched(batches, across: bool):
    """(run, id, block, d, owner) from rows of a block with its entries.

    With `across` only what others need: the block's own vertices with edges to other blocks (`known`), and offers to the ends of these.
    """
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda name: batch[name][i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            net, block = Net(*(cell(c) for c in ("ids", "begins", "far", "length"))), batch["block"][i].as_py()
            out, to, there, beyond = (cell(c) for c in ("out", "to", "there", "beyond"))
            entries = batch["entries"][i].values
            run, ids, d, owner = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("run", "id", "d", "owner"))
            order = np.argsort(run, kind="stable")
            runs, begins = np.unique(run[order], return_index=True)
            for r, at in zip(runs, np.split(order, begins[1:])):
                found = net.reached(list(zip(d[at].tolist(), owner[at].tolist(), np.searchsorted(net.ids, ids[at]).tolist())))
                places = np.fromiter(found, np.int64, len(found))
                near, who = np.array([x for x, _ in found.values()], float), np.array([o for _, o in found.values()], np.int64)
                parts = [(net.ids[places], np.full(len(places), block), near, who, True)]
                if across:
                    all_d, all_who, seen = np.zeros(len(net.ids)), np.zeros(len(net.ids), np.int64), np.zeros(len(net.ids), bool)
                    all_d[places], all_who[places], seen[places] = near, who, True
                    edge = np.unique(out[seen[out]])
                    use = np.flatnonzero(seen[out])
                    far, by = all_d[out[use]] + beyond[use], all_who[out[use]]
                    use_order = np.lexsort((by, far, to[use]))
                    first = use_order[np.unique(to[use][use_order], return_index=True)[1]]
                    parts = [(net.ids[edge], np.full(len(edge), block), all_d[edge], all_who[edge], True), (to[use][first], there[use][first], far[first], by[first], False)]
                for own_ids, blocks, dist, owners, known in parts:
                    n = len(own_ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r)), pa.array(own_ids), pa.array(blocks), pa.array(dist, pa.float64()), pa.array(owners), pa.array(np.full(n, known))], ["run", "id", "block", "d", "owner", "known"])


class Blocks:
    """A graph too large for one task, cut into blocks of near vertices (by x and y, or lon and lat; without them by id).

    A round searches, by Dijkstra inside each block, from all its entries: starts, and vertices that an edge from another block
    reaches. Only entries are kept between rounds, and only blocks with better ones are searched again; so the rounds are as
    many as the blocks that a path passes, not as its edges. Whole blocks are written out once, at the end.
    """

    def __init__(self, graph: Graph):
        net = stored(symmetric(graph.edges).where("length IS NOT NULL"), "net")
        ids = net.select(F.col("src").alias("id")).distinct()
        n, m = ids.count(), net.count() / 2
        most = max(1, round(n * min(1.0, BLOCK_EDGES / max(m, 1))))
        at = placed(graph.vertices)
        if at is None:
            cut = ranked(ids, ["id"], "place").select("id", F.floor(F.col("place") / most).alias("cell"))
        else:
            finite = F.col("x").cast("double").between(-1e300, 1e300) & F.col("y").cast("double").between(-1e300, 1e300)
            places = stored(at[0].where(finite).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropDuplicates(["id"]).join(ids, "id", "left_semi"), "places")
            cut = ids.join(cells(places, most).select("id", "cell"), "id", "left").fillna(-1, ["cell"])
        cut = stored(cut, "cut")
        parts = cut.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * most)).alias("parts"))  # of one place, or without any
        self.block = stored(cut.join(F.broadcast(parts), "cell").select("id", (F.col("cell") * 1_000_000 + F.pmod(F.xxhash64("id"), "parts")).alias("block")), "block")
        rows = net.join(self.block.withColumnRenamed("id", "src"), "src").join(self.block.select(F.col("id").alias("dst"), F.col("block").alias("there")), "dst")
        count = self.block.select("block").distinct().count()
        self.nets = stored(rows.repartition(max(1, count), "block").groupBy("block").applyInArrow(_packed, _BLOCK), "nets")

    def search(self, entries: DataFrame, n: int, across: bool) -> DataFrame:
        """What the n entries (run, id, block, d, owner) reach in their blocks."""
        parts = n // ROW_ENTRIES + 1
        rows = entries.groupBy("block", F.pmod(F.xxhash64("run"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("run", "id", "d", "owner")).alias("entries"))
        return self.nets.join(F.broadcast(rows) if n <= SENT_ENTRIES else rows, "block").mapInArrow(lambda batches: _searched(batches, across), "run long, id long, block long, d double, owner long, known boolean")

    def settled(self, starts: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """All entries of `starts` (run, id, d, owner), once no round makes any better; `before` has those of earlier starts."""
        fresh = starts.join(self.block, "id").select("run", "id", "block", "d", "owner", F.lit(False).alias("known"))
        while True:
            every = fresh if before is None else fresh.unionByName(before.withColumn("known", F.lit(True)).drop("fresh"))
            best = F.struct("d", "owner")
            merged = every.groupBy("run", "id", "block").agg(F.min(best).alias("b"), F.min(F.when(F.col("known"), best)).alias("was"))
            entries = stored(merged.select("run", "id", "block", "b.d", "b.owner", (F.col("was").isNull() | (F.col("b") < F.col("was"))).alias("fresh")), "entries")
            if before is not None:
                forget(before)
            n, better = entries.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
            if not better:
                return entries
            live = entries.where("fresh").select("run", "block").distinct()
            fresh, before = self.search(entries.join(F.broadcast(live) if better <= SENT_ENTRIES else live, ["run", "block"], "left_semi"), n, True), entries

    def reached(self, starts: DataFrame) -> DataFrame:
        """(run, id, d, owner): the least (d, owner) of all that the starts (run, id, d, owner) of each run reach."""
        entries = self.settled(starts)
        found = self.search(entries, entries.count(), False).select("run", "id", "d", "owner")
        return found.unionByName(starts.join(self.block, "id", "left_anti").select("run", "id", "d", "owner"))


def nearest_center(graph: Graph, sample: DataFrame, by: tuple[str, ...] = (), small: int = SMALL_EDGES) -> DataFrame:
    """id, d, owner of every vertex: distance to the nearest sampled one, and its position; ties by position; d null and owner -1 if none reaches it.

    With `by`, columns of the sample that tell several samples apart: an answer for each of them. Graphs of at most `small`
    edges are searched in a task for each sample; in larger ones all samples are searched together, block by block.
    """
    keys = list(by)
    starts = sample.groupBy(*keys, "id").agg(F.min(F.col("pos").cast("long")).alias("owner"))
    net = small_net(graph, small)
    if net is not None:
        shared = graph.vertices.sparkSession.sparkContext.broadcast(net)
        schema = starts.select(*keys, "id").schema.add("d", "double").add("owner", "long")

        def run(key, rows):
            import pyarrow as pa

            n, ids, owners = shared.value, rows["id"].to_pylist(), rows["owner"].to_pylist()
            at = n.places(ids)
            found = n.reached([(0.0, o, i) for i, o in zip(at, owners) if i >= 0])
            alone = [(x, 0.0, o) for x, o, i in zip(ids, owners, at) if i < 0]
            out = [(int(n.ids[i]), d, o) for i, (d, o) in found.items()] + alone
            columns = [pa.array([k.as_py()] * len(out), k.type) for k in key] + [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.int64()))]
            return pa.table(columns, names=[f.name for f in schema.fields])

        constant = starts if keys else starts.withColumn("_all", F.lit(0))
        if not keys:
            schema = constant.select("_all", "id").schema.add("d", "double").add("owner", "long")
        best = constant.groupBy(*(keys or ["_all"])).applyInArrow(run, schema).select(*keys, "id", F.struct("d", "owner").alias("b"))
    else:
        named = stored(ranked(starts.select(*keys).distinct(), keys, "_run"), "runs") if keys else None
        one = starts.withColumn("_run", F.lit(0).cast("long")) if named is None else starts.join(F.broadcast(named), keys)
        best = Blocks(graph).reached(stored(one.select(F.col("_run").alias("run"), "id", F.lit(0.0).alias("d"), "owner"), "starts")).withColumnRenamed("run", "_run")
        best = (best if named is None else best.join(F.broadcast(named), "_run")).select(*keys, "id", F.struct("d", "owner").alias("b"))
    every = graph.vertices.select("id")
    if keys:
        every = every.crossJoin(F.broadcast(starts.select(*keys).distinct()))  # a row for each sample that is asked for
    return every.join(best, [*keys, "id"], "left").select(*keys, "id", F.col("b.d").alias("d"), F.coalesce("b.owner", F.lit(-1)).alias("owner"))


def shortest_paths(graph: Graph, sources: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(source, id, d) from each source to all it reaches; a missing row is unreachable."""
    ids = sources.select(F.col("id").alias("source")).distinct()
    net = small_net(graph, small)
    if net is not None:
        spark = graph.vertices.sparkSession
        shared = spark.sparkContext.broadcast(net)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for source, at in zip(batch["source"].to_pylist(), shared.value.places(batch["source"].to_pylist())):
                    found = shared.value.reached([(0.0, 0, at)]) if at >= 0 else {}
                    to = shared.value.ids[list(found)] if at >= 0 else np.array([source])
                    d = [x for x, _ in found.values()] if at >= 0 else [0.0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), source)), pa.array(to), pa.array(d, pa.float64())], ["source", "id", "d"])

        return stored(ids.repartition("source").mapInArrow(run, "source long, id long, d double"), "paths")
    starts = stored(ids.select(F.col("source").alias("run"), F.col("source").alias("id"), F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("owner")), "starts")
    return stored(Blocks(graph).reached(starts).select(F.col("run").alias("source"), "id", "d"), "paths")


def replace_infinite(rows: DataFrame, scope: list[str], column: str = "d") -> DataFrame:
    """Null distances become 10 times the largest of their scope, 10 where it has none."""
    top = F.max(column).over(Window.partitionBy(*scope)) if scope else F.max(column).over(Window.partitionBy(F.lit(0)))
    return rows.withColumn(column, F.coalesce(column, 10 * F.coalesce(top, F.lit(1.0))))


def betweenness(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness): shortest paths between other vertices that pass each one, ties shared; each pair counts once.

    From every source (all, unless given; then their sums alone) the steps of shortest paths form a net without
    circles. Paths are counted by sending counts along it until none moves on: what arrives after t steps are the
    paths of t steps. Dependencies go back the same way. Edges of length 0 carry no path.
    """
    net = stored(symmetric(graph.edges), "net")
    d = shortest_paths(graph, graph.vertices.select("id") if sources is None else sources)
    near, far = d.select("source", F.col("id").alias("src"), F.col("d").alias("du")), d.select("source", F.col("id").alias("dst"), F.col("d").alias("dv"))
    tight = (F.col("dv") > F.col("du")) & (F.abs(F.col("du") + F.col("length") - F.col("dv")) <= 1e-9 * F.col("dv"))
    steps = stored(near.join(net, "src").join(far, ["source", "dst"]).where(tight).select("source", "src", "dst"), "steps")

    def gathered(front: DataFrame, along: DataFrame, start: str, end: str, value) -> DataFrame:
        """Sum by (source, id) of all that passes, the start included."""
        parts = [front]
        while True:
            front = stored(front.withColumnRenamed("id", start).join(along, ["source", start]).groupBy("source", F.col(end).alias("id")).agg(F.sum(value).alias("v")), "front")
            if front.limit(1).count() == 0:
                whole = parts[0]
                for x in parts[1:]:
                    whole = whole.unionByName(x)
                return stored(whole.groupBy("source", "id").agg(F.sum("v").alias("v")), "front")
            parts.append(front)

    begin = d.where("source = id").select("source", "id", F.lit(1.0).alias("v"))
    paths = gathered(begin, steps, "src", "dst", F.col("v"))
    up, down = paths.select("source", F.col("id").alias("src"), F.col("v").alias("pu")), paths.select("source", F.col("id").alias("dst"), F.col("v").alias("pv"))
    shares = stored(steps.join(up, ["source", "src"]).join(down, ["source", "dst"]).select("source", "src", "dst", (F.col("pu") / F.col("pv")).alias("share")), "steps")
    every = d.select("source", "id", F.lit(1.0).alias("v"))
    through = gathered(every, shares, "dst", "src", F.col("v") * F.col("share")).where("source <> id")
    sums = through.groupBy("id").agg((F.sum(F.col("v") - 1) / 2).alias("betweenness"))
    return graph.vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
