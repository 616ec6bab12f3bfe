"""Winnowing fingerprints. DataFrame functions only.

A text's units are the bytes of its UTF-8. A k-gram is `k` bytes, its hash XXH64 over them; one begins at every byte. SQL
functions keep no state from one byte to the next, so the hash is made anew for each k-gram: at k = 8 it reads one word.
Every window of `w` following k-grams selects the one of least hash, the rightmost of equals; the selected (hash,
position) pairs are the fingerprint. So two texts that share k + w - 1 bytes in a row share a selected hash (the match
guarantee), and positions say where. A text with fewer k-grams than a window holds selects from those it has; one of
fewer than k bytes is one k-gram as it is.

A hash and its place are one number: the hash's upper 48 bits, then 65535 minus the place in its block, so that the
least number is the least hash with rightmost ties. Blocks hold BLOCK windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.llm.common import if_small, partitions, stored

K, W = 8, 8
BLOCK = 16384
LOW = 65535
#: Bytes of text that a bucket of following documents should hold.
BUCKET_BYTES = 32 << 20


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def _numbers(piece: Column, k: int) -> Column:
    """The packed number of each k-gram of a block."""
    count = F.greatest(F.octet_length(piece) - (k - 1), F.lit(1))
    gram = lambda i: F.xxhash64(F.substring(piece, i + 1, F.lit(k)))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: gram(i).bitwiseAND(F.lit(~LOW)).bitwiseOR((F.lit(LOW) - i).cast("long")))


def _selected(piece: Column, k: int, w: int) -> Column:
    """Distinct packed numbers that the windows of a block select, in order of their places."""
    least = lambda x, i: F.least(F.get(x, i), *(F.get(x, i + j) for j in range(1, max(w, 2)) if j < w), F.get(x, i))
    begins = lambda x: F.sequence(F.lit(0), F.greatest(F.size(x) - w, F.lit(0)))
    return let(_numbers(piece, k), lambda x: F.array_distinct(F.transform(begins(x), lambda i: least(x, i))))


def blocks(of: Column, k: int = K, w: int = W) -> Column:
    """array<array<long>>: the packed numbers that the windows of each block of the bytes `of` select."""
    span = k + w - 1
    each = lambda x: F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(x) - span, F.lit(0)) / BLOCK).cast("int"))
    return let(of, lambda x: F.transform(each(x), lambda b: let(F.substring(x, b * BLOCK + 1, F.lit(BLOCK + span - 1)), lambda piece: _selected(piece, k, w))))


def _place(at: Column, packed: Column) -> Column:
    return (at + LOW - packed.bitwiseAND(F.lit(LOW))).cast("long")


def placed(of: Column, at: Column | int = 0) -> Column:
    """blocks() as array<struct<at long, of array<long>>>; the first block begins at byte `at`."""
    return F.transform(of, lambda block, b: F.struct((b.cast("long") * BLOCK + at).alias("at"), block.alias("of")))


def apart(parts: Column, w: int = W) -> Column:
    """placed() without what the part before has selected too: windows on either side of a seam can select one place."""

    def trimmed(p: Column, i: Column, of: Column) -> Column:
        last = lambda q: _place(q["at"], F.element_at(q["of"], -1))
        again = lambda q: F.size(F.filter(F.slice(p["of"], 1, w), lambda v: _place(p["at"], v) <= last(q)))
        return F.when(i == 0, p).otherwise(F.struct(p["at"].alias("at"), F.slice(p["of"], again(F.get(of, i - 1)) + 1, F.size(p["of"])).alias("of")))

    return let(parts, lambda of: F.transform(of, lambda p, i: trimmed(p, i, of)))


def hashes_of(parts: Column) -> Column:
    """array<long>: the selected hashes (48 bits), by position."""
    return F.flatten(F.transform(parts, lambda p: F.transform(p["of"], lambda v: F.shiftright(v, 16))))


def positions_of(parts: Column) -> Column:
    """array<long>: where the selected k-grams begin, in bytes from 0."""
    return F.flatten(F.transform(parts, lambda p: F.transform(p["of"], lambda v: _place(p["at"], v))))


def windows(of: Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash long, position long>> that the windows of the bytes `of` select, by position (in bytes, from 0)."""
    return let(apart(placed(blocks(of, k, w)), w), lambda x: F.arrays_zip(hashes_of(x).alias("hash"), positions_of(x).alias("position")))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes by all hashes of two sets: 0 to 1, and 1 for two empty ones."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def digest(hashes: Column, positions: Column) -> Column:
    """Selected hashes and positions as 32 hex digits: two 64-bit hashes of both arrays."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), hashes, positions))), 16, "0")
    return F.concat(half(1), half(2))


def winnow(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, selected (hash and position of each selected k-gram, by position) of every row.

    A null text is empty: one k-gram of no bytes. Equal texts, and repeated rows, get equal fingerprints; other columns are
    ignored; an empty table gives no rows.
    """
    return docs.select("doc_id", F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"), windows(F.coalesce(F.col("text"), F.lit("")).cast("binary"), k, w).alias("selected"))


def _bucket(docs: DataFrame, n: int) -> Column:
    """A number that rises with (_key, _hash), cutting the rows into about n even buckets.

    Up to 255 bounds are quantiles (to 1 in 10,000) of _key; between two of them buckets are of equal width. Rows of
    a key that fills whole quantiles are cut by _hash.
    """
    few = min(n, 256)
    bounds = docs.agg(F.percentile_approx("_key", [i / few for i in range(few + 1)], 10000).alias("b")).first()["b"]
    if not bounds:
        return F.lit(0).cast("long")
    cells = -(-n // few)
    array = F.array(*(F.lit(int(x)).cast("long") for x in bounds))
    count = lambda f: F.aggregate(F.transform(array, lambda x: f(x).cast("int")), F.lit(0), lambda a, b: a + b)
    upto, below = count(lambda x: x <= F.col("_key")), count(lambda x: x < F.col("_key"))
    low, high = F.get(array, upto - 1).cast("double"), F.get(array, upto).cast("double")
    cell = F.coalesce(F.floor((F.col("_key") - low) * F.lit(float(cells)) / F.greatest(high - low, F.lit(1.0))), F.lit(0))
    spread = F.floor((F.col("_hash").cast("double") / float(1 << 64) + 0.5) * (upto - below) * cells)
    own = F.when(upto - below > 1, below * cells + F.least(spread, (upto - below) * cells - 1)).otherwise(upto * cells + F.greatest(F.least(cell, F.lit(cells - 1)), F.lit(0)))
    return own.cast("long")


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how alike it is to that and to the next document's.

    doc_id, n_chars, edited_sha256, hashes and positions (in bytes) of the selected k-grams, edited_hashes and
    edited_positions, near_edited, near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document in descending doc_id; after the last one comes the first. Rows of equal doc_id follow each other by a
    hash of the text, null ids come last. A document alone in its table is its own next one.

    What is kept is the head. A fingerprint is the union of what the windows inside the head select and what those
    reaching past it select, so the edited text needs hashes for its new end only. Only texts move: k-grams are hashed
    where a bucket's rows already stand in order.
    """
    span = k + w - 1
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("_hash", F.xxhash64("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    base = base.withColumn("bucket", _bucket(base, max(4 * partitions(docs.sparkSession), -(-size // BUCKET_BYTES))))
    chars = F.char_length("text")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int"))
    edge = F.greatest(F.col("kept_bytes") - (span - 1), F.lit(0))
    # Of a head of less than a window, all windows reach past it, and so does what a short text has of one.
    none = F.array().cast("array<array<long>>")

    def reaching(c: Column) -> Column:
        short, rest = F.col("kept_bytes") < span, F.substring(c.cast("binary"), edge + 1, F.octet_length(c))
        return F.when(short | (F.octet_length(rest) >= span), blocks(rest, k, w)).otherwise(none)

    def fingerprinted(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("n_chars", chars.cast("long")).withColumn("kept_bytes", F.octet_length(kept))
        head = blocks(F.substring(F.col("text").cast("binary"), F.lit(1), F.col("kept_bytes")), k, w)
        rows = rows.withColumn("head", placed(F.when(F.col("kept_bytes") >= span, head).otherwise(none)))
        rows = rows.withColumn("own", apart(F.concat("head", placed(reaching(F.col("text")), edge)), w))
        return rows.withColumn("hashes", hashes_of(F.col("own"))).withColumn("set", F.array_distinct("hashes"))

    order = [F.col("_key").desc(), F.col("_hash").desc()]
    rows = base.repartition("bucket").sortWithinPartitions("bucket", *order)
    packed = fingerprinted(rows).withColumn("next", F.lead(F.struct("text", "set")).over(Window.partitionBy("bucket").orderBy(*order)))
    # The last row of a bucket is followed by the first one of the next lower bucket that has rows.
    tops = if_small(base.groupBy(F.col("bucket").alias("_bucket")).agg(F.max(F.struct("_key", "_hash")).alias("_top")))
    firsts = base.join(tops, (F.col("bucket") == F.col("_bucket")) & (F.col("_key") == F.col("_top._key")) & (F.col("_hash") == F.col("_top._hash"))).groupBy("bucket").agg(F.min("text").alias("text"))
    edges = fingerprinted(firsts).select("bucket", F.struct("text", "set").alias("first"))
    edges = stored(edges, "winnow-edges")
    every = Window.orderBy(F.col("bucket").desc())
    order = edges.select("bucket").withColumn("_to", F.coalesce(F.lead("bucket").over(every), F.first("bucket").over(every)))
    edges = edges.withColumnRenamed("bucket", "_to").join(order.withColumnRenamed("bucket", "_from"), "_to").select("_from", "first")
    rows = packed.withColumn("_last", F.when(F.col("next").isNull(), F.col("bucket"))).join(if_small(edges), F.col("_last") == F.col("_from"), "left")
    rows = rows.withColumn("next", F.coalesce("next", "first")).drop("_last", "_from", "first")
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next.text"), F.lit(1), cut)))
    rows = rows.withColumn("other", apart(F.concat("head", placed(reaching(F.col("edited")), edge)), w)).withColumn("edited_hashes", hashes_of(F.col("other")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "hashes", positions_of(F.col("own")).alias("positions"), "edited_hashes", positions_of(F.col("other")).alias("edited_positions"),
        likeness(F.col("set"), F.array_distinct("edited_hashes")).alias("near_edited"), likeness(F.col("set"), F.col("next.set")).alias("near_next"),
    )
