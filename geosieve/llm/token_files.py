"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.llm.common import if_small, partitions
from geosieve.llm.tokens import BATCH_BYTES, batches_of, default_tokenizer, encoder, texts_of

END = 1
#: Bytes of text for each file, on average at most.
FILE_BYTES = 128 << 20


def tokenized(tokenizer: str, end: int | None, carry: list[str], queue: str | None = None, batch_bytes: int = BATCH_BYTES, as_bytes: bool = False):
    """A mapInArrow function: rows with `text` become `carry`, part, start_in_part, n_tokens, tokens.

    start_in_part: the ids of the part's rows before this one; with `queue`, of those with the same value there.
    as_bytes: tokens are little-endian bytes, two an id where the vocabulary allows it, else four.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        queues: dict = {}
        kind = enc.kind if end is None or end < 1 << 16 else np.dtype("<u4")
        for whole in batches:
            texts = [*texts_of(whole["text"])]
            for low, high in batches_of(texts, batch_bytes):
                batch = whole.slice(low, high - low)
                flat, sizes = enc.encode_batch(texts[low:high])
                if end is not None:
                    flat, sizes = np.insert(flat, np.cumsum(sizes), end), sizes + 1
                begins = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                if queue:
                    for i, q in enumerate(batch[queue].to_pylist()):
                        begins[i] = queues.get(q, 0)
                        queues[q] = int(begins[i] + sizes[i])
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                if as_bytes:
                    places = pa.py_buffer((bounds * kind.itemsize).astype(np.int32))
                    tokens = pa.Array.from_buffers(pa.binary(), len(sizes), [None, places, pa.py_buffer(flat.astype(kind))])
                else:
                    tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(np.full(len(sizes), part, np.int32)), pa.array(begins), pa.array(sizes), tokens], [*carry, "part", "start_in_part", "n_tokens", "tokens"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END, stripe_mb: int = 8) -> None:
    """Encodes every text and writes ids as ORC in ascending doc_id order, one file a range of ids.

    Files hold doc_id, part (the file's place), start_in_part (ids of the file's documents before it), n_tokens
    and tokens. ORC writes the integers in run-length form, keeps row indexes for each 1,000 rows and a Bloom
    filter on doc_id; a reader splits a file by stripes. A null text has only the end id, a null doc_id stands
    first, rows of equal doc_id follow each other by a hash of the text and may go to several files; other columns are ignored. An empty table
    gives files without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    rows = rows.repartitionByRange(max(partitions(spark), -(-size // FILE_BYTES)), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    out = rows.mapInArrow(tokenized(tokenizer or default_tokenizer(), end, ["doc_id"]), "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>")
    options = {"orc.compress": "ZSTD", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_mb << 20)}
    out.write.options(**options).mode("overwrite").orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with `doc_ids`, only those, found through row indexes and Bloom filters."""
    rows = spark.read.schema("doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _digest(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        tokens = batch["tokens"]
        flat, bounds = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), tokens.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
        sizes = np.diff(bounds).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], batch["start_in_part"], pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    Where a file begins is the sum of n_tokens over the files before it: a scan of two small columns, and a
    window over one row a file.
    """
    rows = read_token_files(spark, path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    begins = sums.select("part", F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    read = rows.select("doc_id", "part", "start_in_part", "tokens").mapInArrow(_digest, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return read.join(if_small(begins), "part").select("doc_id", (F.col("_begin") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
