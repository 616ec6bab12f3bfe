"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed length.

Each source's documents, end to end, are one queue of tokens. The whole stream is dealt out in shares: share k of K
holds, of a queue of N tokens, those from round(N k / K) to round(N (k + 1) / K). So what a source has got at a
share's end differs from its due by half a token at most, however many shares there are; that remainder is the
deficit carried into the next one. Inside a share a round-robin fills one window after the other. Every window adds
to a source's deficit its part of the window; the source with the largest deficit gives the next slice (at least
`slice_tokens`, so that sources due less than one token a window stay whole), pays for it, and carries what it still has, or owes, into the
next window. Windows are counted over the whole stream: a window begun in one share is ended by the next one, so
only the very last window can be short, and that one is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.llm.common import if_small, stored
from geosieve.llm.token_files import END, tokenized
from geosieve.llm.tokens import default_tokenizer, release

WINDOW = 2048
#: The least tokens that a queue gives at a time, unless a document, window or queue ends: what a source owes, or is owed, stays near it.
SLICE_TOKENS = 16
#: Bytes of text encoded together: less than for token files, as tasks here also hold shares.
BATCH_BYTES = 4 << 20
#: Tokens in a share: what one task holds at a time (2 or 4 bytes each).
SHARE_TOKENS = 1 << 20


def share_of(position: int, n: int, shares: int) -> int:
    """The share that holds a token."""
    k = position * shares // n
    while k and (2 * n * k + shares) // (2 * shares) > position:
        k -= 1
    while (2 * n * (k + 1) + shares) // (2 * shares) <= position:
        k += 1
    return k


def _cut(shares: int, last_use: bool = False):
    """mapInArrow: a document's tokens, cut where the shares of its queue begin."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if last_use:
            release()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: list[tuple] = []
                names = ("tokens", "n_tokens", "doc_id", "source_no", "position", "queue_tokens")
                for tokens, size, doc, source, position, n in zip(*(batch[c].to_pylist() for c in names)):
                    begin, width = 0, len(tokens) // size
                    while begin < size:
                        k = share_of(position + begin, n, shares)
                        stop = min(size, (2 * n * (k + 1) + shares) // (2 * shares) - position)
                        out.append((k, source, position + begin, doc, begin, size, tokens[width * begin : width * stop], width))
                        begin = stop
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["share", "source_no", "position", "doc_id", "start", "doc_tokens", "ids", "width"])

    return run


def round_robin(queues: list[int], first_room: int, window: int, slice_tokens: int) -> list[tuple[int, int]]:
    """(queue, tokens) slices in order, ending every queue; windows end after first_room tokens and each `window` more."""
    total = sum(queues)
    left, part = np.array(queues, np.int64), np.array(queues, float) / max(total, 1)
    deficit, out, room, done = part * first_room, [], first_room, 0
    while done < total:
        if room == 0:
            room = window
            deficit += part * window
        q = int(np.argmax(np.where(left > 0, deficit, -np.inf)))
        take = int(min(room, left[q], max(slice_tokens, np.ceil(deficit[q]))))
        left[q] -= take
        deficit[q] -= take
        out.append((q, take))
        room -= take
        done += take
    return out


def _powers(size: int) -> list[int]:
    return [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]


def _fill(sizes: dict[int, int], shares: int, total: int, window: int, slice_tokens: int, last_use: bool = False):
    """applyInArrow over one share: its pieces with their sequences and offsets. sizes: tokens of each queue."""
    last = total // window * window  # from here on: powers of two

    def run(rows):
        import pyarrow as pa

        if last_use:
            release()
        rows = rows.sort_by([("source_no", "ascending"), ("position", "ascending")])
        k = rows["share"][0].as_py()
        at = sum((2 * n * k + shares) // (2 * shares) for n in sizes.values())
        sources = rows["source_no"].to_numpy()
        docs, starts, doc_tokens, ids = (rows[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        names, firsts = np.unique(sources, return_index=True)
        wide = rows["width"][0].as_py()  # bytes of an id, the same for all
        kind = np.dtype(f"<u{wide}")
        lengths = np.array([len(x) // wide for x in ids], np.int64)
        queues = [int(x) for x in np.add.reduceat(lengths, firsts)]
        row, used = [int(x) for x in firsts], [0] * len(names)
        out: list[tuple] = []
        for q, take in round_robin(queues, window - at % window, window, slice_tokens):
            while take:
                r, u = row[q], used[q]
                size = min(take, int(lengths[r]) - u)
                # A piece also ends where a window, or a power of two of the last one, ends.
                if at < last:
                    sequence, offset, room = at // window, at % window, window - at % window
                else:
                    sequence, offset, room = last // window, at - last, 0
                    for p in _powers(total - last):
                        if offset < p:
                            room = p - offset
                            break
                        sequence, offset = sequence + 1, offset - p
                size = min(size, room)
                piece = np.frombuffer(ids[r], kind, size, wide * u).astype("<u4").tobytes()
                out.append((docs[r], starts[r] + u, size, zlib.crc32(piece), doc_tokens[r], sequence, offset, int(names[q]), piece))
                at, take, used[q] = at + size, take - size, u + size
                if used[q] == lengths[r]:
                    row[q], used[q] = r + 1, 0
        kinds = (*[pa.int64()] * 8, pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=list(FIELDS))

    return run


FIELDS = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long", "source_no": "long", "ids": "binary"}


def pack(docs: DataFrame, tokenizer: str | None = None, end: int | None = END, window: int = WINDOW, slice_tokens: int = SLICE_TOKENS, share_tokens: int = SHARE_TOKENS, last_use: bool = False) -> DataFrame:
    """A row for each piece of a document in a sequence: FIELDS, with the piece's ids as unsigned 32-bit integers.

    A source's target is its part of all tokens, so all queues last to the end; each document is packed once.
    Null texts are empty (only the end id). A null source is a source; rows of equal doc_id, or none, are
    documents of their own. The number of sources is held by the driver and each task, documents never are. Empty
    tables give no rows. With `last_use` workers drop the tokenizer once all is encoded, instead of keeping it for the next call.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(tokenized(tokenizer or default_tokenizer(), end, ["doc_id", "source"], "source", BATCH_BYTES, as_bytes=True), "doc_id long, source string, part int, start_in_part long, n_tokens long, tokens binary")
    rows = stored(rows.where("n_tokens > 0"), "pack-tokens")
    # The order of a queue: by part of the stored table, then as the part has them (start_in_part). Its sums are by (source, part).
    sums = stored(rows.groupBy("source", "part").agg(F.sum("n_tokens").alias("_sum")), "pack-sums")
    totals = sums.groupBy("source").agg(F.sum("_sum").alias("queue_tokens")).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    sizes = {r["source_no"]: r["queue_tokens"] for r in totals.select("source_no", "queue_tokens").collect()}
    total = sum(sizes.values())
    if not total:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in FIELDS.items()))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("_begin", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    begins = begins.alias("b").join(totals.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("_source"), F.col("part").alias("_part"), "_begin", "source_no", "queue_tokens")
    shares = max(1, -(-total // share_tokens))
    joined = rows.join(if_small(begins), (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    cut = joined.select("doc_id", "source_no", (F.col("_begin") + F.col("start_in_part")).alias("position"), "queue_tokens", "n_tokens", "tokens").mapInArrow(_cut(shares, last_use), "share long, source_no long, position long, doc_id long, start long, doc_tokens long, ids binary, width long")
    return cut.groupBy("share").applyInArrow(_fill(sizes, shares, total, window, slice_tokens, last_use), ", ".join(f"{c} {t}" for c, t in FIELDS.items()))

