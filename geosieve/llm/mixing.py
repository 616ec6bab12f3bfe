"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.llm.common import free_names, if_small, stored, with_offsets

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Rows that a task orders at once.
BUCKET_ROWS = 1_000


def sized(docs: DataFrame, seed: int, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words), key: 60 random bits fixed by doc_id, text and seed; and the columns `also`."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *also)


def source_targets(rows: DataFrame, share: float, cap: float) -> DataFrame:
    """source, source_size, target: share of all words by weight, none above cap times its source's size.

    The shares that caps cut off go to the others by weight, until none is above: with sources by rising
    cap / weight, the first whose weighted part of what is left stays below its cap ends the capped ones.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    by = Window.orderBy((F.col("source_size") * cap / F.col("_weight")), "_rank")
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("_weight", weight)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_all", F.sum("source_size").over(every))
    s = s.withColumn("_capped", F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_left", F.sum("_weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all") * share - F.col("_capped") * cap) / F.col("_left"))
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("source_size") * cap, F.struct("_capped", "_level"))).over(every)["_level"]
    return s.withColumn("_final", level).select("source", "source_size", F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce(F.col("_final") * F.col("_weight"), F.col("source_size") * F.lit(float(cap)))).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 42, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row, and the columns `also`, by which equal ids stand.

    A source's documents stand in the order of their keys, which rows share only if doc_id and text are equal; so reruns
    agree in any order of rows. A source takes as many whole epochs as its target (rounded)
    holds, and of the next epoch the first words up to the exact budget, so the last document may be taken in
    part. Null texts have size 0 and take nothing; a null source is a source, ranked last; repeated rows stand
    side by side and are taken one by one; a null doc_id counts as the empty id. Empty tables give no rows.
    """
    rows = stored(sized(docs, seed, also), "mix-sizes")
    # A source's buckets are ranges of keys, as many as its rows need.
    counts = rows.groupBy(F.col("source").alias("_name")).agg(F.least(F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / BUCKET_ROWS)), F.lit(0)), F.lit(40)).cast("int").alias("_bits"))
    rows = rows.join(if_small(counts), F.col("source").eqNullSafe(F.col("_name"))).withColumn("_bucket", F.expr("shiftright(key, 60 - _bits)")).drop("_name", "_bits")
    placed = with_offsets(rows, ["source"], "_bucket", ["key", "doc_id", "size", *also], "size", "_before")
    goals = source_targets(rows, share, cap).withColumnRenamed("source", "_source")
    placed = placed.join(if_small(goals), placed["source"].eqNullSafe(goals["_source"]))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("_before"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *also)


def mixed_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix as documents: each row as often as it is taken whole, and one copy cut after its last taken word.

    A document of no words takes no part; n_chars follows a cut text, in which all up to the cut stays as it was. Rows
    are told apart by all their columns, not by doc_id, which may be null or repeated.
    """
    # Equal rows are one here: together they are taken whole so many times, and one of them at most in part.
    text, others, size, taken, n, whole, part, copy = free_names(docs.columns, "_text", "_others", "_words", "_taken", "_rows", "_whole", "_part", "_copy")
    rest = [c for c in docs.columns if c != "text"]
    named = docs.withColumn(text, F.sha2("text", 256)).withColumn(others, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256))
    name = [text, others]
    rows = stored(mix(named, share, cap, seed, tuple(name)).where("taken > 0").select(*name, F.col("size").alias(size), F.col("taken").alias(taken)), "mix-taken")
    per_row = rows.groupBy(*name).agg(F.count(F.lit(1)).alias(n), F.sum(F.floor(F.col(taken) / F.col(size))).alias(whole), F.max(F.col(taken) % F.col(size)).alias(part))
    one = named.dropDuplicates(name) if per_row.where(F.col(n) > 1).limit(1).count() else named
    got = one.join(per_row.drop(n), name)
    copies = got.withColumn(copy, F.explode(F.concat(F.array_repeat(F.lit(0), F.col(whole).cast("int")), F.when(F.col(part) > 0, F.array(F.col(part).cast("int"))).otherwise(F.array().cast("array<int>")))))
    words = F.regexp_extract_all("text", F.lit(f"({SPACE}*{WORD})"))
    cut = F.when(F.col(copy) > 0, F.array_join(F.slice(words, 1, F.greatest(F.col(copy), F.lit(1))), "")).otherwise(F.col("text"))
    out = copies.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(copy) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
