"""Nearest neighbours by largest inner product: stable projections in a kd-tree with a chi-square stopping test.

With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0): then the largest inner product is
the least distance d. Projected on PROJECTIONS Gaussian directions (2-stable), a distance d becomes r with r^2 / d^2
following the chi-square law. A query visits nodes of a kd-tree over the projections in order of projected distance and
verifies, on the original vectors, the points whose own r passes the test: r^2 below the law's CONFIDENCE quantile times
d_k^2, with d_k the distance of the k-th best so far. Once the next r fails it, a point that should be among the k is
unseen with a probability of 1 - CONFIDENCE at most, and the query stops.

The upper part of the tree is fitted on a bounded sample and deals all points into cells, each point into one. A query
searches its own cell first; d_k from there says which other cells it must go to, and no other cell sees it. Cells of
too many rows (a vector repeated often) are cut by a hash of vec_id, and a cell's queries into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.llm.common import stored

PROJECTIONS, CONFIDENCE, LEAF = 16, 0.92, 32
#: Rows that a cell should have, rows of a cell that one task indexes at most, and queries that it searches them for.
CELL_ROWS, SHARD_ROWS, QUERY_ROWS = 4096, 8192, 4096
#: The sample that the cells are fitted on: rows and bytes at most; and rows of it in each cell at least.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_LEAF = 20_000, 16 << 20, 16
#: Queries searched together, and pairs of query and point compared at once.
TOGETHER, PAIRS = 512, 1 << 16
#: Share of a leaf's pairs that pass the test from which a matrix product sieves them; rounding of such products, relative.
SIEVE, ROUNDING = 0.05, 1e-9
SEED = 3
PLACED = "vec_id long, embedding array<double>, low array<double>, cell int"
FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """For even m, by bisection of 1 - exp(-x/2) sum (x/2)^i / i!."""
    law = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if law(mid) < p else (low, mid)
    return high


def directions(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, PROJECTIONS))


def lowered(vectors: np.ndarray, largest: float | None) -> np.ndarray:
    """Projections of points (largest: M squared) or of queries (None)."""
    g = directions(vectors.shape[1])
    if largest is None:
        return vectors @ g[:-1]
    return vectors @ g[:-1] + np.sqrt(np.maximum(largest - (vectors**2).sum(1), 0))[:, None] * g[-1]


class Tree:
    """A kd-tree of `depth` levels, halved at medians along the widest axis; boxes of all nodes, children of i at 2 i + 1 and 2 i + 2."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.order = depth, np.arange(len(points))
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        self.bounds = np.array([0, len(points)])
        lows, highs = [], []
        for level in range(depth + 1):
            whole = points[self.order]
            lows.append(np.minimum.reduceat(whole, self.bounds[:-1]))
            highs.append(np.maximum.reduceat(whole, self.bounds[:-1]))
            if level == depth:
                break
            bounds = [0]
            for i, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:])):
                node, axis, mid = (1 << level) - 1 + i, int((highs[-1][i] - lows[-1][i]).argmax()), (a + b) // 2
                own = self.order[a:b]
                self.order[a:b] = own = own[np.argsort(points[own, axis], kind="stable")]
                self.axis[node], self.cut[node] = axis, points[own[mid - a - 1], axis]
                bounds += [mid, b]
            self.bounds = np.array(bounds)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf on each point's side of all cuts."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)

    def leaves_within(self, points: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, squared distance) of the leaves whose box is nearer than `most` (squared), going down from the root."""
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        axes = list(zip(*(np.ascontiguousarray(c.T) for c in (points, self.low, self.high))))
        for level in range(self.depth + 1):
            r = np.zeros(len(q))
            for point, low, high in axes:  # one at a time, as pairs times axes would be large
                p = point.take(q)
                r += np.maximum(np.maximum(low.take(node) - p, p - high.take(node)), 0) ** 2
            keep = r < most[q]
            q, node, r = q[keep], node[keep], r[keep]
            if level < self.depth:
                q, node = np.repeat(q, 2), (2 * node[:, None] + np.array([1, 2])).ravel()
        return q, node - ((1 << self.depth) - 1), r


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, largest: float, k: int, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of each query's k best here, best first, ties by id, -inf where there are fewer; how many pairs were verified.

    far: the squared distance of each query's k-th best elsewhere, if known (else infinite); points farther than it are left out.
    """
    low_points, low_queries = lowered(points, largest), lowered(queries, None)
    tree = Tree(low_points, max(0, math.ceil(math.log2(len(points) / LEAF))))
    limit, norms = chi_square_quantile(CONFIDENCE, PROJECTIONS), (queries**2).sum(1)
    best, names = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    far, verified = np.full(len(queries), np.inf) if far is None else far.copy(), 0
    # Matrix products sieve pairs; as their sums differ by rounding, they let this much more through.
    size_points, size_queries = (low_points**2).sum(1), (low_queries**2).sum(1)
    slack, low_slack = ROUNDING * (largest + norms), ROUNDING * (size_points.max(initial=0) + size_queries)
    side_points = np.column_stack([low_points, np.ones(len(points)), size_points])
    side_queries = np.column_stack([-2 * low_queries, size_queries, np.ones(len(queries))])  # times side_points: r^2
    least = np.where(np.isinf(far), -np.inf, (largest + norms - far) / 2 - slack)  # k points elsewhere have as much

    def passing(q: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) that may pass the test and be among the k best, of each (query, leaf); leaf by leaf."""
        nonlocal verified
        order = np.argsort(leaf, kind="stable")
        q, leaf = q[order], leaf[order]
        ends = np.append(np.flatnonzero(np.diff(leaf)) + 1, len(leaf))
        reach, enough = limit * far + low_slack, np.maximum(best[:, -1] - slack, least)
        found = []
        for begin, end in zip(np.append(0, ends[:-1]), ends):
            a, b = q[begin:end], tree.order[tree.bounds[leaf[begin]] : tree.bounds[leaf[begin] + 1]]
            near = side_queries.take(a, 0) @ side_points.take(b, 0).T < reach[a, None]
            passed = np.count_nonzero(near)
            verified += passed
            if passed > SIEVE * near.size:
                near &= queries.take(a, 0) @ points.take(b, 0).T >= enough[a, None]
            i, j = np.divmod(np.flatnonzero(near), len(b))
            found.append((a[i], b[j]))
        a, b = zip(*found)
        return np.concatenate(a), np.concatenate(b)

    def verify(q: np.ndarray, leaf: np.ndarray) -> None:
        """Looks at all points of each (query, leaf) whose projection passes the test."""
        if not len(q):
            return
        whole_q, whole_p = passing(q, leaf)
        found = []
        for i in range(0, len(whole_q), PAIRS):
            a, b = whole_q[i : i + PAIRS], whole_p[i : i + PAIRS]
            near = (((low_queries[a] - low_points[b]) ** 2).sum(1) < limit * far[a]) & (query_ids[a] != ids[b])
            a, b = a[near], b[near]
            scores = np.einsum("pd,pd->p", queries[a], points[b], optimize=False)  # the same sum wherever a pair stands
            better = scores >= np.maximum(best[a, -1], least[a])
            found.append((a[better], scores[better], ids[b[better]]))
        a, scores, got = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        some = np.unique(a)
        a, scores, got = np.concatenate([a, np.repeat(some, k)]), np.concatenate([scores, best[some].ravel()]), np.concatenate([got, names[some].ravel()])
        order = np.lexsort((got, -scores, a))
        a, scores, got = a[order], scores[order], got[order]
        first = np.searchsorted(a, some)
        top = (first[:, None] + np.arange(k)).ravel()
        best[some], names[some] = scores[top].reshape(-1, k), got[top].reshape(-1, k)
        with np.errstate(invalid="ignore"):
            far[some] = np.minimum(far[some], np.maximum(largest + norms[some] - 2 * best[some, -1], 0))

    for begin in range(0, len(queries), TOGETHER):
        own = np.arange(begin, min(len(queries), begin + TOGETHER))
        home = tree.leaf_of(low_queries[own])
        fresh = np.isinf(far[own])
        verify(own[fresh], home[fresh])
        q, leaf, r = tree.leaves_within(low_queries[own], limit * far[own])
        keep = ~(fresh[q] & (leaf == home[q]))
        q, leaf, r = q[keep], leaf[keep], r[keep]
        order = np.lexsort((r, q))
        q, leaf, r = q[order], leaf[order], r[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)  # the place of each leaf on its query's way
        low, step = 0, 1
        while len(q) and low <= turn.max():  # nearer leaves first, in steps that grow
            now = (turn >= low) & (turn < low + step) & (r < limit * far[own[q]])
            verify(own[q[now]], leaf[now])
            low, step = low + step, step * 2
    return best, names, verified


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part: ids, and vectors neither null, zero nor holding null or non-finite numbers."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column, width: int) -> np.ndarray:
    rows = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes, flat = np.diff(rows.offsets.to_numpy()), rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _lists(rows: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def _dealt(tree: Tree, width: int, largest: float):
    """mapInArrow: each point with its projections and its cell."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            low = lowered(matrix(b["embedding"], width), largest)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["embedding"], _lists(low), pa.array(tree.leaf_of(low).astype(np.int32))], ["vec_id", "embedding", "low", "cell"])

    return run


def _aimed(cells: list, width: int):
    """mapInArrow: a row for each cell that a query, knowing `far` from its own, must go to."""
    low, high = np.array([c["low"] for c in cells]), np.array([c["high"] for c in cells])
    numbers, limit = np.array([c["cell"] for c in cells]), chi_square_quantile(CONFIDENCE, PROJECTIONS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                q = lowered(matrix(b["embedding"], width), None)
                r = (np.maximum(np.maximum(low - q[:, None], q[:, None] - high), 0) ** 2).sum(2)
                goes = (r < limit * b["far"].to_numpy()[:, None]) & (numbers != b["home"].to_numpy()[:, None])
                i, j = np.nonzero(goes)
                yield pa.RecordBatch.from_arrays([b["query_id"].take(pa.array(i)), b["embedding"].take(pa.array(i)), b["far"].take(pa.array(i)), pa.array(numbers[j].astype(np.int32))], ["query_id", "embedding", "far", "cell"])

    return run


def _searched(points: DataFrame, queries: DataFrame, shards: DataFrame, width: int, largest: float, k: int) -> DataFrame:
    """FOUND of queries (query_id, embedding, far, cell) among the points of their cells."""
    by = lambda c, count, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.col(count).cast("long")).cast("int")
    queries = stored(queries, "queries")
    plan = F.broadcast(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks")).join(shards, "cell"))
    many = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = queries.join(plan, "cell").withColumn("block", by("query_id", "blocks", 2)).withColumn("shard", many("shards"))
    right = points.join(plan, "cell").withColumn("shard", by("vec_id", "shards", 1)).withColumn("block", many("blocks"))

    def run(a, b):
        import pyarrow as pa

        if not (a.num_rows and b.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        names = a["query_id"].to_numpy()
        best, found, _ = search(matrix(a["embedding"], width), names, matrix(b["embedding"], width), b["vec_id"].to_numpy(), largest, k, a["far"].to_numpy())
        real = best > -np.inf
        return pa.table({"query_id": np.repeat(names, k)[real.ravel()], "vec_id": found[real], "score": best[real]})

    keys = ["cell", "shard", "block"]
    return left.select(*keys, "query_id", "embedding", "far").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInArrow(run, FOUND)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, its k best of all other rows.

    Every row is in an index; only its cells are fitted on a sample. Of rows with equal vec_id the least vector takes
    part; shorter vectors count as padded with zeros. Tables without usable rows, or with one only, give no rows.
    """
    spark = vectors.sparkSession
    v = stored(usable(vectors), "vectors")
    n, width, largest = v.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width))
    sample = v.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(min(1.0, rows / n) * (1 << 30)))).select("embedding").toArrow()["embedding"]
    depth = max(0, min(math.ceil(math.log2(n / cell_rows)), int(math.log2(max(1, len(sample) / SAMPLE_LEAF)))))
    tree = Tree(lowered(matrix(sample, width), largest) if len(sample) else np.zeros((1, PROJECTIONS)), depth)
    points = stored(v.mapInArrow(_dealt(tree, width, largest), PLACED), "cells")
    ends = {name: F.array(*(f(F.get("low", F.lit(i))) for i in range(PROJECTIONS))).alias(name) for name, f in (("low", F.min), ("high", F.max))}
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends.values()).collect()
    shards = spark.createDataFrame([(c["cell"], -(-c["n"] // SHARD_ROWS)) for c in cells], "cell int, shards int")
    points = points.select("vec_id", "embedding", "cell")
    queries = points.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.lit(float("inf")).alias("far"), "cell")
    top = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    first = stored(top(_searched(points, queries, shards, width, largest, k)).select("query_id", "vec_id", "score"), "first")
    if len(cells) > 1:
        known = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
        far = F.when(F.col("kth").isNull(), float("inf")).otherwise(F.greatest(norm + largest - 2 * F.col("kth"), F.lit(0.0)))
        aimed = queries.join(known, "query_id", "left").select("query_id", "embedding", far.alias("far"), F.col("cell").alias("home"))
        aimed = aimed.mapInArrow(_aimed(cells, width), "query_id long, embedding array<double>, far double, cell int")
        first = first.unionByName(_searched(points, aimed, shards, width, largest, k))
    return top(first).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
