"""K-d tree sharding: weighted medians along the widest metadata dimension until leaves reach the target bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.llm.common import SMALL_ROWS, if_small, stored, with_offsets

#: Coordinates are 62 bits: 20 of the dimension's value, 32 of the text's CRC-32, 10 of the row.
VALUE_BITS, CRC_BITS, ROW_BITS = 20, 32, 10
BITS = VALUE_BITS + CRC_BITS + ROW_BITS
#: A round of the median search cuts a node's range into so many parts.
PARTS_BITS = 10
#: A cut may miss the median by this part of the node's bytes, unless one row is larger.
TOLERANCE = 2e-4
#: Rows that a task orders at once.
BUCKET_ROWS = 20_000
#: Rows from which a group of equal texts counts as large.
GROUP_ROWS = 200
#: Of nodes equally wide along several dimensions the first here is split.
DIMENSIONS = ("source", "language", "length", "arrival")


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """(name, _rank): the values in code point order, nulls first, spread evenly over the range of a coordinate."""
    values = rows.select(name).distinct()
    every = Window.orderBy(F.col(name).asc_nulls_first())  # one row for each distinct value
    top = F.lit(float((1 << VALUE_BITS) - 1))
    return values.select(F.col(name).alias(f"_{name}"), F.floor(F.percent_rank().over(every) * top).cast("long").alias(f"_rank_{name}"))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a coordinate for each dimension.

    Rows of equal texts are one group, placed by its least source, least language, length and least doc_id (which
    stands for the time of arrival). Ties of a dimension are ordered by the text's CRC-32, then by ten hashed bits of
    doc_id; so equal texts stay together unless the cut falls into their group, and a group of any size can still be cut.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    column = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_text"), column("source").alias("source"), column("lang").alias("language"))
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("_text").agg(F.min("source").alias("source"), F.min("language").alias("language"), F.min("doc_id").alias("arrival"), F.count(F.lit(1)).alias("_n"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    top = (1 << VALUE_BITS) - 1
    for name in ("source", "language"):
        ranks = _ranked(rows, name)
        groups = groups.join(if_small(ranks), F.col(name).eqNullSafe(F.col(f"_{name}")), "left")
    part = (F.col("arrival").cast("double") - float(low or 0)) / float(max(1, (high or 0) - (low or 0)))
    values = {
        "source": F.col("_rank_source"), "language": F.col("_rank_language"),
        "length": F.least(F.floor(F.log2(F.col("size")) * F.lit(float(1 << VALUE_BITS) / 48)), F.lit(top)),
        "arrival": F.coalesce(F.least(F.floor(part * F.lit(float(top))), F.lit(top)), F.lit(0)),
    }
    below = F.shiftleft("text_crc32", ROW_BITS) + F.xxhash64(F.col("doc_id")).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    groups = stored(groups.select("_text", "arrival", "_rank_source", "_rank_language", "_n"), "shard-groups")
    # Rows of large groups of copies meet their group where they are; the others' by a shuffle, in which no group is large.
    large = F.broadcast(groups.where(F.col("_n") > GROUP_ROWS).orderBy(F.col("_n").desc(), "_text").limit(SMALL_ROWS))
    rows = rows.drop("source", "language")
    placed = rows.join(large, "_text").unionByName(rows.join(large.select("_text"), "_text", "left_anti").join(groups, "_text"))
    return placed.select("doc_id", "size", "text_crc32", *((F.shiftleft(v.cast("long"), CRC_BITS + ROW_BITS) + below).alias(k) for k, v in values.items()))


def _widest(stats: dict, whole: dict) -> str:
    """The dimension along which a node spans most of what the whole table spans there."""
    value = lambda of, end, d: of[f"{end}_{d}"] >> (CRC_BITS + ROW_BITS)
    span = lambda of, d: value(of, "high", d) - value(of, "low", d)
    return max(DIMENSIONS, key=lambda d: span(stats, d) / max(1, span(whole, d)))


def split_points(rows: DataFrame, target_bytes: float) -> list[dict]:
    """The tree as a list of nodes (id, dimension, cut); children of i are 2 i + 1 (up to the cut) and 2 i + 2.

    All nodes of a level search for their medians together: each round sums sizes by node and part of its range
    (at most nodes * 2**PARTS_BITS sums reach the driver) and goes on inside the part that holds the median.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    levels = max(0, round((total / target_bytes - 1e-9)).bit_length() - 1) if target_bytes else 0
    tree: list[dict] = []
    whole: dict | None = None
    for level in range(levels):
        ids = range((1 << level) - 1, (1 << level + 1) - 1)
        at = node_of(tree, level)
        held = rows.withColumn("_node", at)
        spans = {r["_node"]: r.asDict() for r in held.groupBy("_node").agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max)))).collect()}
        whole = whole or spans.get(0)
        find = {i: {"id": i, "dimension": (d := _widest(spans[i], whole)), "low": spans[i][f"low_{d}"], "high": spans[i][f"high_{d}"], "before": 0, "bytes": spans[i]["bytes"]} for i in ids if i in spans}
        open_ = set(find)
        while open_:
            value, low, shift = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(0)
            for i in open_:
                f = find[i]
                f["shift"] = max(0, (f["high"] - f["low"]).bit_length() - PARTS_BITS)
                here = F.col("_node") == i
                value = F.when(here & F.col(f["dimension"]).between(f["low"], f["high"]), F.col(f["dimension"])).otherwise(value)
                low = F.when(here, F.lit(f["low"])).otherwise(low)
                shift = F.when(here, F.lit(f["shift"])).otherwise(shift)
            part = F.expr("shiftright(_value - _low, _shift)")
            sums = held.withColumn("_value", value).withColumn("_low", low).withColumn("_shift", shift).where("_value IS NOT NULL").groupBy("_node", part.alias("part")).agg(F.sum("size").alias("s")).collect()
            parts: dict[int, list] = {}
            for r in sums:
                parts.setdefault(r["_node"], []).append((r["part"], r["s"]))
            for i in list(open_):
                f, before = find[i], find[i]["before"]
                for p, s in sorted(parts[i]):
                    begin, end = f["low"] + (p << f["shift"]), f["low"] + ((p + 1) << f["shift"]) - 1
                    if before + s >= f["bytes"] / 2:
                        if f["shift"] and s > TOLERANCE * f["bytes"]:
                            f |= {"low": begin, "high": end, "before": before}
                        else:  # whichever side of this part is nearer to the middle
                            f["cut"] = end if before + s - f["bytes"] / 2 <= f["bytes"] / 2 - before else begin - 1
                            open_.discard(i)
                        break
                    before += s
        tree += [{"id": i, "dimension": find[i]["dimension"], "cut": find[i]["cut"]} if i in find else {"id": i, "dimension": DIMENSIONS[0], "cut": 0} for i in ids]
    return tree


def node_of(tree: list[dict], level: int) -> Column:
    """The id of the row's node at a level."""

    def below(i: int, depth: int) -> Column:
        if depth == level:
            return F.lit(i)
        return F.when(F.col(tree[i]["dimension"]) <= tree[i]["cut"], below(2 * i + 1, depth + 1)).otherwise(below(2 * i + 2, depth + 1))

    return below(0, 0)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in its shard) of every row.

    `shards` must be a power of two: leaves of the tree at the target of total / shards bytes. Sizes of shards are as equal as
    TOLERANCE a level and single rows allow. A null text has size 1, a null source or lang is a value of its own, repeated rows may
    share a shard or not and have slots of their own, null ids come first in a shard. Tables without `source` or `lang`
    count as null there; other columns are ignored. An empty table gives no rows.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError(f"shards must be a power of two, not {shards}")
    rows = stored(metadata(docs), "shard-metadata")
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    levels = shards.bit_length() - 1
    tree = split_points(rows, (total or 0) / shards)
    made = min(levels, len(tree).bit_length())
    placed = rows.withColumn("shard", (node_of(tree, made) - F.lit((1 << made) - 1)).cast("int"))
    cells = max(1, -(-n // BUCKET_ROWS))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = 1 if low is None else max(1, -(-(high - low + 1) // cells))
    placed = placed.withColumn("_cell", F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)), F.lit(-1)))
    return with_offsets(placed, ["shard"], "_cell", ["doc_id", "text_crc32"], None, "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
