"""Bounded samples of labelled rows to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32(doc_id as text) mod folds."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % folds


#: The most labels for which a full sample is drawn; with more, each gets less.
MOST_LABELS = 64


def labelled_texts(docs: DataFrame, label: str, where: Column, per_class: int, most_bytes: int, labels: DataFrame | None = None) -> list[tuple]:
    """About `per_class` (text, label) rows of each label that hold `where`, by hashed doc_id.

    The counts cover all rows; those whose hash is below per_class / count are the sample, so it doesn't grow with the
    table. Of a text of over most_bytes characters a piece is learned from, whose place the hash of doc_id says. The driver
    holds per_class * MOST_LABELS pieces at most.
    """
    held = (labels if labels is not None else docs).where(where & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = held.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), label).limit(per_class * MOST_LABELS).collect()
    if not counts:
        return []
    each = min(per_class, max(1, per_class * MOST_LABELS // len(counts)))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rates = docs.sparkSession.createDataFrame([(r[label], min(1.0, each / r["_n"])) for r in counts], held.select(F.col(label).alias("_label")).schema.add("_rate", "double"))
    chosen = held.join(F.broadcast(rates), F.col(label) == F.col("_label")).where(part < F.col("_rate"))
    if labels is not None:
        # At most about per_class rows a label, so their ids are few.
        chosen = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", label).dropDuplicates(["doc_id"])), "doc_id")
    over = F.greatest(F.char_length("text") - most_bytes, F.lit(0))
    begin = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("piece")), (over + 1).cast("long")).cast("int") + 1
    rows = chosen.select("doc_id", F.substring(F.col("text"), begin, F.lit(most_bytes)).alias("text"), label).collect()
    return [(r["text"], r[label]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or "")) if r["text"] is not None]
