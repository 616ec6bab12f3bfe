"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, and connected components.

Candidates: 64 bits are cut into 4 + r blocks; of two fingerprints that differ in at most 4 bits, r blocks are equal in
both. So each distinct fingerprint goes to a bucket for each choice of r blocks, and every linked pair meets in one. r is
1 up to some millions of fingerprints and rises with their number, so that buckets stay small. Inside one an index finds the links: fingerprints sorted by Gray rank (neighbours there share most
bits), runs of them under nodes that hold the bits all members agree on, and bits that a parent holds already left out
below, so that going down only adds differences. A group is dropped once its accumulated differences pass the limit.
A bucket returns a spanning forest of its links, not all pairs: groups already joined to the query are dropped too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.common import discard, free_names, if_small, lean, stored
from geosieve.llm.tokens import texts_of

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Members or nodes under a node, and queries searched at once.
FANOUT, QUERIES = 8, 256
#: Shingles hashed at once.
CHUNK = 1 << 16
#: Fingerprints that a bucket should have at most, were they spread evenly.
BUCKET = 4096


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    import xxhash

    words = raw.lower().split()  # bytes: only A-Z are lowered, and the white space is 20 and 09-0D
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    del words
    n, ends, counts = len(sizes) - shingle + 1, np.cumsum(sizes), np.zeros(64, np.int64)
    begins = (ends - sizes)[:n]
    for at in range(0, n, CHUNK):
        spans = zip(begins[at : at + CHUNK].tolist(), (ends[shingle - 1 :][at : at + CHUNK] - 1).tolist())
        found = np.array([hash_(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) and the columns `also` of every row; null and blank texts have 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lean()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                fps = np.array([fingerprint(x, shingle) for x in texts_of(batch["text"])], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps), *(batch[c] for c in also)], ["doc_id", "fp", *also])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also)
    schema = rows.select("doc_id").schema.add("fp", "long")
    for c in also:
        schema = schema.add(rows.schema[c])
    return rows.mapInArrow(run, schema)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each number in the Gray order."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels from leaves to roots: pattern and mask (agreed bits that no parent holds) of each node."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        agreed, pattern = [np.full(len(fps), ~np.uint64(0))], [self.fps]
        while len(pattern[-1]) > FANOUT:
            at = np.arange(0, len(pattern[-1]), FANOUT)
            ones, any_ = np.bitwise_and.reduceat(pattern[-1], at), np.bitwise_or.reduceat(pattern[-1], at)
            mask = np.bitwise_and.reduceat(agreed[-1], at) & ~(ones ^ any_)
            agreed.append(mask)
            pattern.append(ones & mask)
        self.pattern = pattern
        self.mask = [m & ~np.repeat(up, FANOUT)[: len(m)] for m, up in zip(agreed[:-1], agreed[1:])] + [agreed[-1]]

    def forest(self, limit: int) -> list[tuple[int, int]]:
        """Pairs of places (in the given order) within `limit` bits that connect all that such pairs connect."""
        n, root, out = len(self.fps), np.arange(len(self.fps)), []

        def join(a: np.ndarray, b: np.ndarray) -> None:
            for x, y in zip(a.tolist(), b.tolist()):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                while root[y] != y:
                    root[y] = root[root[y]]
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((x, y))

        def labels() -> list[np.ndarray]:
            """Of each node on each level, the root that all its members have, else -1."""
            nonlocal root
            while (root != root[root]).any():
                root = root[root]
            levels = [root]
            for p in self.pattern[1:]:
                at = np.arange(0, len(levels[-1]), FANOUT)
                low, high = np.minimum.reduceat(levels[-1], at), np.maximum.reduceat(levels[-1], at)
                levels.append(np.where(low == high, low, -1))
            return levels

        near = np.flatnonzero(np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= limit)
        join(near, near + 1)
        made = -1
        for begin in range(0, n, QUERIES):
            if made < len(out):
                same, made = labels(), len(out)
            top = len(self.pattern) - 1
            q = np.repeat(np.arange(begin, min(n, begin + QUERIES)), len(self.pattern[top]))
            node = np.tile(np.arange(len(self.pattern[top])), min(n, begin + QUERIES) - begin)
            have = np.zeros(len(q), np.uint8)
            for level in range(top, -1, -1):
                have = have + np.bitwise_count((self.fps[q] ^ self.pattern[level][node]) & self.mask[level][node])
                keep = (have <= limit) & (same[level][node] != root[q])
                q, node, have = q[keep], node[keep], have[keep]
                if level and len(q):
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, have = np.repeat(q, FANOUT), np.repeat(have, FANOUT)
                    real = node < len(self.pattern[level - 1])
                    q, node, have = q[real], node[real], have[real]
            join(q, node)
        return [(int(self.order[a]), int(self.order[b])) for a, b in out]


def _linked(limit: int):
    """mapInArrow over rows sorted by bucket: the links of each bucket, between the nodes' numbers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def answer(fps: list, nodes: list):
            fps, nodes = np.concatenate(fps), np.concatenate(nodes)
            if len(fps) > 1 and (pairs := GrayIndex(fps.view(np.uint64)).forest(limit)):
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

        lean()
        key, fps, nodes = None, [], []
        for batch in batches:
            keys = batch["key"].to_numpy()
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            f, m = batch["fp"].to_numpy(), batch["node"].to_numpy()
            for a, b in zip(bounds[:-1], bounds[1:]):
                if a == b:
                    continue
                if keys[a] != key and fps:
                    yield from answer(fps, nodes)
                    fps, nodes = [], []
                key = keys[a]
                fps.append(f[a:b])
                nodes.append(m[a:b])
        if fps:
            yield from answer(fps, nodes)

    return run


def links(distinct: DataFrame, limit: int = DISTANCE, equal: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes of `distinct` (fp, node) that connect all fingerprints within `limit` bits.

    equal: how many blocks a bucket's fingerprints share; by default the least for which buckets have BUCKET on average.
    """
    if equal is None:
        n, equal = distinct.count(), 1
        while equal < 4 and n >> (64 * equal // (limit + equal)) > BUCKET:
            equal += 1
    blocks = limit + equal
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    spans, keys = [*zip(bounds[:-1], bounds[1:])], []
    chosen = [*combinations(spans, equal)]
    for i, some in enumerate(chosen):
        key = F.lit(0).cast("long")
        for low, high in some:
            key = F.shiftleft(key, high - low).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)))
        keys.append(key * len(chosen) + i)
    rows = distinct.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    rows = rows.repartition("key").sortWithinPartitions("key", "fp")
    return rows.select("key", "fp", "node").mapInArrow(_linked(limit), "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) of every node on an edge.

    Each round links a node's larger neighbours, then its smaller ones, to the least node next to it, until each node has one
    edge, to its component's least. Rounds grow with the logarithm of the size; each is written to the shared folder.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, name)
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, name)
        same = small.join(pairs, ["u", "v"], "left_anti").limit(1).count() == 0 and pairs.join(small, ["u", "v"], "left_anti").limit(1).count() == 0
        discard(edges.sparkSession, pairs.inputFiles()[0].rsplit("/", 1)[0]) if pairs.inputFiles() else None
        pairs = small
        if same:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _classes(marked: DataFrame, limit: int) -> DataFrame:
    """(_fp, label, component_id) of each distinct fingerprint: the least fingerprint reachable, and the smallest doc_id."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = components(links(distinct.select("fp", F.col("fp").alias("node")), limit))
    labelled = distinct.join(if_small(found), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("label"), "first")
    labelled = stored(labelled, "simhash-labels")
    least = labelled.groupBy(F.col("label").alias("_label")).agg(F.min("first").alias("component_id"))
    return labelled.join(least, F.col("label") == F.col("_label")).select(F.col("fp").alias("_fp"), "label", "component_id")


def near_duplicates(docs: DataFrame, limit: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most `limit` bits) of every row.

    Equal fingerprints are one node, so a group of copies of any size is one row to the index. Rows with a null doc_id
    take part like others; where a component has no doc_id, component_id is null. Repeated rows, and rows of one doc_id
    with different texts, stay, each with its own text's component. Empty tables give no rows.
    """
    marked = stored(fingerprints(docs, shingle), "simhash")
    return marked.join(if_small(_classes(marked, limit)), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, limit: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component: that of the smallest doc_id (a null one is larger than all).

    Rows that share it are told apart by a hash of all their columns, of which the least is kept; of wholly equal rows
    one. So what is kept depends neither on the order of rows nor on partitions, and no text is lost but near copies.
    """
    (mark,) = free_names(docs.columns, "_mark")
    plain = [F.to_json(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in docs.schema.fields]
    rows = docs.withColumn(mark, F.xxhash64(*plain))
    marked = stored(fingerprints(rows, shingle, (mark,)), "simhash")
    placed = marked.join(if_small(_classes(marked, limit)), F.col("fp") == F.col("_fp"))
    least = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(mark).alias("mark"))).alias("lead"), F.count(F.lit(1)).alias("n"))
    leads = stored(least.select(F.col("lead.doc_id").alias("_lead"), F.col("lead.mark").alias("_lead_mark")), "simhash-leads")
    kept = rows.join(if_small(leads), (F.col(mark) == F.col("_lead_mark")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_lead")), "left_semi")
    if marked.groupBy("doc_id", mark).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([mark])
    return kept.select(*docs.columns)
