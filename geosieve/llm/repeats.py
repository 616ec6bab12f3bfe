"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash over TRIGGER bytes makes triggers: the places with the least hash in some window of LENGTH bytes (rather
than those divisible by a number, so that every string of LENGTH bytes holds one, equal strings hold the same ones, and
phrases stay short in texts of any kind). Triggers cut texts into phrases; each phrase ends with the trigger that the
next one begins with. A string of LENGTH bytes that holds a trigger is a suffix of the phrase that the trigger ends,
then a prefix of what the parse has after it; so it lies within REACH bytes on either side. Phrase and rest, cut there, are
an entry of the dictionary, with the smallest doc_id that has it.

1. parse: each batch sends its distinct triggers' hashes (48 bits), dealt by value; those that two documents have survive.
2. dictionary: each batch sends its distinct entries around surviving triggers, dealt by trigger. There the phrases are
   sorted from their ends (so that those with an equal suffix are neighbours) and the rests of the parse from their
   beginnings, each order with the lengths that neighbours share. For each place in a phrase the two orders combine into
   the order of the corpus strings that begin there, in which equal strings are neighbours; each learns whether a
   smaller document has it. Only bytes are compared: no two strings meet by a hash alone.
3. corpus: each batch parses its texts again, lays the answers over its bytes and cuts.

What is sent is combined in each batch first: a passage that a third of all documents hold is one entry a batch. Entries
of a trigger that very many batches have are dealt by half of their context and the trigger instead, twice: strings
that reach further to the left meet by the left half, the others by the right one; so no bucket holds all contexts of a
frequent phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.common import free_names, lean, partitions, stored
from geosieve.llm.tokens import texts_of

LENGTH, TRIGGER = 50, 20
REACH = LENGTH - TRIGGER
WIDTH = LENGTH + REACH
#: Bytes of text in a batch (a longer text is one), and parsed at once.
BATCH_BYTES, SEGMENT = 4 << 20, 1 << 16
#: Bytes of text for each part that triggers and entries are dealt to.
BUCKET_BYTES = 8 << 20
#: A trigger that so many batches have is dealt with half of its context; the bytes of a half.
HOT_BATCHES, HALF = 256, (LENGTH - TRIGGER) // 2
#: A null doc_id counts as the largest.
LAST = np.iinfo(np.int64).max
#: No byte of UTF-8: stands outside the text.
OUTSIDE = 255

_rng = np.random.default_rng(20)
_BYTES = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WORDS = _rng.integers(0, 1 << 63, WIDTH // 8, np.uint64) * np.uint64(2) + np.uint64(1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of 48-bit keys."""
    return (keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)


def _runs(keys: np.ndarray, buckets: int) -> tuple[list[int], np.ndarray]:
    """The buckets that sorted keys fall into, and where each one's keys begin (and the last one's end)."""
    some, first = np.unique(bucket_of(keys, buckets), return_index=True)
    return some.tolist(), np.append(first, len(keys))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` bytes in a row, along the last axis: joined from hashes of 1, 2, 4 ... bytes."""
    part, size, out, done = _BYTES[data], 1, None, 0
    while True:
        if length & size:
            if out is None:
                out = part
            else:
                n = min(out.shape[-1], part.shape[-1] - done)
                out = out[..., :n] * _power(size) + part[..., done : done + n]
            done += size
        if size * 2 > length:
            break
        part = part[..., :-size] * _power(size) + part[..., size:]
        size *= 2
    out = out[..., : data.shape[-1] - length + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _extreme(x: np.ndarray, width: int, of) -> np.ndarray:
    """of() (minimum or maximum) of each `width` numbers in a row."""
    size = 1
    while size * 2 <= width:
        x, size = of(x[:-size], x[size:]), size * 2
    return of(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Batch:
    """Texts side by side: bytes, where each begins, and their doc_ids."""

    def __init__(self, data: bytes, sizes: list[int], ids: list[int]):
        self.data = np.frombuffer(data, np.uint8)
        self.sizes, self.ids = np.array(sizes, np.int64), np.array(ids, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])

    def parse(self) -> None:
        """Triggers: places, text of each, and the distinct hashes in order (48 bits)."""
        n, reach, places, hashes = len(self.data), REACH, [], []
        for low in range(0, max(0, n - LENGTH + 1), SEGMENT):
            a, b = max(0, low - reach), min(n, low + SEGMENT + reach + TRIGGER)
            h = _rolling(self.data[a:b], TRIGGER) | np.uint64(1)
            least = _extreme(h, reach + 1, np.minimum)  # of each place where a string of LENGTH begins
            # No string of LENGTH begins in the last bytes of a text (nor in those of the one before a shorter text).
            ends = self.begins[np.searchsorted(self.begins, a, "right") : np.searchsorted(self.begins, a + len(least) + LENGTH)]
            short = (ends[:, None] - np.arange(1, LENGTH)).ravel() - a
            least[short[(short >= 0) & (short < len(least))]] = 0
            pad = np.zeros(reach, np.uint64)
            most = _extreme(np.concatenate([pad, least, pad]), reach + 1, np.maximum)
            own = np.flatnonzero(most[: len(h)] == h[: len(most)]) + a
            own = own[(own >= low) & (own < low + SEGMENT)]
            places.append(own)
            # Least hashes are small ones; mixed again they spread evenly over the buckets.
            mixed = h[own - a] * np.uint64(0xC2B2AE3D27D4EB4F)
            hashes.append((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x165667B19E3779F9) >> np.uint64(16))
        self.places = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.text = np.searchsorted(self.begins, self.places, "right") - 1
        self.values, self.value_of = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)

    def shared(self) -> np.ndarray:
        """Of each distinct hash, whether two documents of the batch have it."""
        ids, low, high = self.ids[self.text], np.full(len(self.values), LAST), np.full(len(self.values), -LAST)
        np.minimum.at(low, self.value_of, ids)
        np.maximum.at(high, self.value_of, ids)
        return low < high

    def entries(self, survives: np.ndarray, hot: np.ndarray) -> None:
        """Distinct entries around surviving triggers, as they are sent (in order of the keys that deal them); the entry of each place."""
        keep = survives[self.value_of]
        self.at, owner, value = self.places[keep], self.text[keep], self.value_of[keep]
        ids, n = self.ids[owner], len(self.at)
        around = np.empty((n, WIDTH), np.uint8)
        for i in range(0, n, 1 << 14):
            s = slice(i, i + (1 << 14))
            index = self.at[s, None] + np.arange(-REACH, WIDTH - REACH)
            inside = (index >= self.begins[owner[s], None]) & (index < self.begins[owner[s] + 1, None])
            around[s] = np.where(inside, self.data[np.clip(index, 0, len(self.data) - 1)], OUTSIDE)
        self.around = around
        order, first = grouped(around, ids, value)
        self.first = np.empty(n, np.int64)
        self.first[order] = order[first]
        sent = order[np.unique(first)] if n else order
        twice = sent[hot[value[sent]]]
        once = sent[~hot[value[sent]]]
        halves = [_rolling(around[twice, a:b], HALF + TRIGGER)[:, 0] >> np.uint64(16) for a, b in ((REACH - HALF, LENGTH), (REACH, LENGTH + HALF))]
        keys = np.concatenate([self.values[value[once]], *halves])
        by_key = np.argsort(keys, kind="stable")
        self.sent, self.sent_keys = np.concatenate([once, twice, twice])[by_key], keys[by_key]
        self.larger = ids > ids[self.first]
        self.owner_ids = ids


def grouped(rows: np.ndarray, ids: np.ndarray, value: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows are together, smallest id first; for each place in it, where its group begins."""
    n = len(rows)
    words = np.ascontiguousarray(rows).view(np.uint64).reshape(n, -1)
    mark = (((words ^ (words >> np.uint64(29))) * _WORDS) ^ (words >> np.uint64(7))).sum(1, dtype=np.uint64)
    mark = (mark ^ (mark >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    order = np.lexsort((ids, mark))
    sorted_ = mark[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    if n and not (words[order] == words[order[first]]).all():  # two rows with one fingerprint: order by the bytes
        void = np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel()
        _, mark = np.unique(void, return_inverse=True)
        order = np.lexsort((ids, mark))
        sorted_ = mark[order]
        new[1:] = sorted_[1:] != sorted_[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return order, first


def possible(rows: np.ndarray) -> np.ndarray:
    """Bit c of each row: bytes c to c + LENGTH lie in the text."""
    left = (rows[:, :REACH] == OUTSIDE).sum(1)
    right = (rows[:, LENGTH:] == OUTSIDE).sum(1)
    c = np.arange(REACH + 1)
    fits = (c >= left[:, None]) & (c + LENGTH <= WIDTH - right[:, None])
    return (fits.astype(np.uint32) << c.astype(np.uint32)).sum(1, dtype=np.uint32)


def ranked(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings of one length, by bytes; how many bytes each shares with the one before (-1 for the first)."""
    strings = np.ascontiguousarray(strings)
    width = strings.shape[1]
    order = np.argsort(strings.view(f"S{width}").ravel(), kind="stable")
    shared = np.full(len(order), -1, np.int64)
    for i in range(1, len(order), 1 << 16):
        a, b = strings[order[i - 1 : i - 1 + (1 << 16)]], strings[order[i : i + (1 << 16)]]
        unlike = a[: len(b)] != b
        shared[i : i + (1 << 16)] = np.where(unlike.any(1), unlike.argmax(1), width)
    return order, shared


def answers(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bit c of each row: a row of smaller id has the same bytes c to c + LENGTH."""
    can, n = possible(rows), len(rows)
    out = np.zeros(n, np.uint32)
    order, first = grouped(rows, ids)
    larger = ids[order] > ids[order[first]]
    out[order[larger]] = can[order[larger]]  # a smaller document has all of it
    lead = order[np.unique(first)] if n else order
    phrases, shared_ends = ranked(rows[lead, LENGTH - 1 :: -1])
    rests, shared_starts = ranked(rows[lead, LENGTH:])
    lead_ids, phrase, rest = ids[lead], np.empty(len(lead), np.int64), np.empty(len(lead), np.int64)
    for c in range(REACH + 1):
        # Strings from byte c on: phrases that share their last LENGTH - c bytes, and rests that share their first c.
        phrase[phrases] = np.cumsum(shared_ends < LENGTH - c)
        rest[rests] = np.cumsum(shared_starts < c)
        held = np.flatnonzero(can[lead] >> np.uint32(c) & np.uint32(1))
        if not len(held):
            continue
        place = phrase[held] * (len(lead) + 1) + rest[held]
        o = np.argsort(place)
        place, own = place[o], held[o]
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        least = np.repeat(np.minimum.reduceat(lead_ids[own], begins), np.diff(np.append(begins, len(own))))
        out[lead[own[lead_ids[own] > least]]] |= np.uint32(1 << c)
    # A first row's answers hold for the others of its document.
    out[order] |= np.where(larger, 0, out[order[first]]).astype(np.uint32)
    return out


# --- the three passes -------------------------------------------------------------------------------------------


def _codec():
    import pyarrow as pa

    return pa.Codec("zstd", compression_level=3)


def _batched(batches: Iterator) -> Iterator:
    """Documents to rows of one batch each: batch, doc_ids, sizes, plain (bytes), texts (compressed)."""
    import pyarrow as pa
    from pyspark import TaskContext

    lean()
    codec, part, count = _codec(), TaskContext.get().partitionId(), 0
    ids: list = []
    texts: list[bytes] = []
    size = 0

    def row():
        raw = b"".join(texts)
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
        values = ((part << 32) + count, ids, [len(x) for x in texts], len(raw), codec.compress(raw, asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["batch", "doc_ids", "sizes", "plain", "texts"])

    for b in batches:
        for doc_id, text in zip(b["doc_id"].to_pylist(), texts_of(b["text"])):
            if texts and size + len(text) > BATCH_BYTES:
                yield row()
                ids, texts, size, count = [], [], 0, count + 1
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield row()


def _open(row: dict) -> Batch:
    raw = _codec().decompress(row["texts"], row["plain"], asbytes=True)
    batch = Batch(raw, row["sizes"], [LAST if x is None else x for x in row["doc_ids"]])
    batch.parse()
    return batch


def _rows(batches: Iterator) -> Iterator[dict]:
    lean()
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _send_triggers(buckets: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in _rows(batches):
            batch = _open(row)
            (some, cuts), shared = _runs(batch.values, buckets), batch.shared()
            six = batch.values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            runs = [*zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([six[a:b].tobytes() for a, b in runs], pa.binary()), pa.array([np.packbits(shared[a:b]).tobytes() for a, b in runs], pa.binary())],
                ["bucket", "batch", "hashes", "shared"],
            )

    return run


def _survivors(hot_batches: int):
    """applyInArrow over a bucket: for each batch, a bit for each of its hashes: two documents have it; and one, if any: very many batches have it."""

    def run(rows):
        return _judged_triggers(rows, hot_batches)

    return run


def _judged_triggers(rows, hot_batches: int):
    import pyarrow as pa

    lean()
    found, shared, sizes = [], [], []
    for h, s in zip(rows["hashes"].to_pylist(), rows["shared"].to_pylist()):
        six = np.frombuffer(h, np.uint8).reshape(-1, 6)
        wide = np.zeros((len(six), 8), np.uint8)
        wide[:, :6] = six
        found.append(wide.view("<u8").ravel())
        shared.append(np.unpackbits(np.frombuffer(s, np.uint8))[: len(six)].astype(bool))
        sizes.append(len(six))
    all_, both = np.concatenate(found), np.concatenate(shared)
    order = np.argsort(all_, kind="stable")
    s = all_[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    hit = (count > 1) | (np.bincount(group, weights=both[order]) > 0)
    keep, hot = np.empty(len(s), bool), np.empty(len(s), bool)
    keep[order], hot[order] = hit[group], (hit & (count >= hot_batches))[group]
    cuts = np.cumsum([0, *sizes])
    packed = lambda x: [np.packbits(x[a:b]).tobytes() if x[a:b].any() else b"" for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"batch": rows["batch"], "bucket": rows["bucket"], "bits": pa.array(packed(keep), pa.binary()), "hot": pa.array(packed(hot), pa.binary())})


def _with_entries(row: dict, buckets: int) -> tuple[Batch, list[int], np.ndarray]:
    """The batch with its entries, the buckets they are sent to, and where each one's begin."""
    batch = _open(row)
    some, cuts = _runs(batch.values, buckets)
    run_of, survives, hot = dict(zip(some, zip(cuts[:-1], cuts[1:]))), np.zeros(len(batch.values), bool), np.zeros(len(batch.values), bool)
    for got in row["survivors"] or []:
        a, b = run_of[got["bucket"]]
        for flags, bits in ((survives, got["bits"]), (hot, got["hot"])):
            if bits:
                flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8))[: b - a]
    batch.entries(survives, hot)
    return batch, *_runs(batch.sent_keys, buckets)


def _send_entries(buckets: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec()
        for row in _rows(batches):
            batch, some, cuts = _with_entries(row, buckets)
            sent = [batch.sent[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([codec.compress(batch.around[s].tobytes(), asbytes=True) for s in sent], pa.binary()), pa.array([batch.owner_ids[s].tobytes() for s in sent], pa.binary())],
                ["bucket", "batch", "entries", "ids"],
            )

    return run


def _judged(rows):
    """applyInArrow over a bucket: the answers for each batch's entries."""
    import pyarrow as pa

    lean()
    codec = _codec()
    ids = [np.frombuffer(x, np.int64) for x in rows["ids"].to_pylist()]
    entries = [np.frombuffer(codec.decompress(e, len(i) * WIDTH, asbytes=True), np.uint8).reshape(-1, WIDTH) for e, i in zip(rows["entries"].to_pylist(), ids)]
    masks = answers(np.concatenate(entries), np.concatenate(ids))
    cuts = np.cumsum([0, *(len(i) for i in ids)])
    return pa.table({"batch": rows["batch"], "bucket": rows["bucket"], "masks": pa.array([masks[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _name(doc_id: int | None, text: bytes) -> str:
    """What tells the answers of a table apart: they depend on a row's text and doc_id alone."""
    return f"{hashlib.sha256(text).hexdigest()}:{'' if doc_id is None else doc_id}"


def _cut(buckets: int, named: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in _rows(batches):
            batch, some, cuts = _with_entries(row, buckets)
            begin_of, masks = dict(zip(some, cuts)), np.zeros(len(batch.sent), np.uint32)
            for got in row["answers"] or []:
                found = np.frombuffer(got["masks"], np.uint32)
                masks[begin_of[got["bucket"]] : begin_of[got["bucket"]] + len(found)] = found
            known = np.zeros(len(batch.at), np.uint32)
            np.bitwise_or.at(known, batch.sent, masks)
            mask = np.where(batch.larger, possible(batch.around), known[batch.first]) if len(batch.at) else known
            starts = np.zeros(len(batch.data) + 1, np.int32)
            for c in range(REACH + 1):
                starts[batch.at[(mask >> np.uint32(c) & np.uint32(1)) > 0] - REACH + c] = 1
            sums = np.cumsum(starts)[:-1]
            sums[LENGTH:] -= sums[:-LENGTH].copy()
            removed = sums > 0
            out = []
            for doc_id, a, b in zip(row["doc_ids"], batch.begins[:-1], batch.begins[1:]):
                gone = removed[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out.append((int(b - a), edges.tolist(), batch.data[a:b][~gone].tobytes(), _name(doc_id, batch.data[a:b].tobytes()) if named and len(edges) else None))
            n, edges, kept, names = zip(*out)
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(n, pa.int64()), pa.array(edges, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            more = [pa.array(names, pa.string())] if named else []
            yield pa.RecordBatch.from_arrays(columns + more, ["doc_id", "n_bytes", "edges", "kept", "name"][: len(columns + more)])

    return run


def without_repeats(docs: DataFrame, named: bool = False, hot_batches: int = HOT_BATCHES) -> DataFrame:
    """doc_id, n_bytes, edges (begin and end of each maximal removed run, by turns), kept (the bytes left) of every row.

    With `named`, also name: of rows that lose something, their text's SHA-256 and doc_id.

    A byte is removed if a string of LENGTH bytes over it also starts in a document of smaller doc_id, judged on the input.
    Null texts are empty; a null doc_id counts as larger than all others; rows of equal doc_id remove nothing from each
    other; other columns are ignored; an empty table gives no rows. A task holds one batch, and so one text, whole.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = stored(texts.mapInArrow(_batched, "batch long, doc_ids array<long>, sizes array<long>, plain long, texts binary"), "repeats-texts", "uncompressed")
    total = texts.agg(F.sum("plain")).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    sent = texts.mapInArrow(_send_triggers(buckets), "bucket int, batch long, hashes binary, shared binary")
    bits = sent.groupBy("bucket").applyInArrow(_survivors(hot_batches), "batch long, bucket int, bits binary, hot binary")
    survivors = stored(bits.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("survivors")), "repeats-survivors")
    known = texts.join(survivors, "batch", "left")
    sent = known.mapInArrow(_send_entries(buckets), "bucket int, batch long, entries binary, ids binary")
    masks = sent.groupBy("bucket").applyInArrow(_judged, "batch long, bucket int, masks binary")
    judged = stored(masks.groupBy("batch").agg(F.collect_list(F.struct("bucket", "masks")).alias("answers")), "repeats-answers")
    both = survivors.join(judged, "batch", "left")
    return texts.join(both, "batch", "left").mapInArrow(_cut(buckets, named), "doc_id long, n_bytes long, edges array<long>, kept binary" + (", name string" if named else ""))


def _digest(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        shas = [hashlib.sha256(x.as_py()).hexdigest() for x in b["kept"]]
        edges = b["edges"].to_pylist()
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array([sum(e[1::2]) - sum(e[::2]) for e in edges], pa.int64()), pa.array([len(e) // 2 for e in edges], pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _decoded(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        texts = [x.as_py().decode("utf-8", "ignore") for x in b["kept"]]
        yield pa.RecordBatch.from_arrays([b["name"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["_name", "_text", "_chars"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings cut out of their texts; n_chars follows. Half characters at a cut go too.

    Texts without repeats stay as they are, nulls too; a text of which nothing is left is empty. Cuts go to rows by doc_id
    and text, so doc_ids may be null or repeated.
    """
    name, text, chars, row = free_names(docs.columns, "_name", "_text", "_chars", "_row")
    kept = without_repeats(docs, True).where("name IS NOT NULL").mapInArrow(_decoded, "_name string, _text string, _chars long").toDF(name, text, chars)
    rows = docs.withColumn(row, F.concat(F.sha2("text", 256), F.lit(":"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))))
    if rows.where(F.col(row).isNotNull()).groupBy(row).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([name])
    out = rows.join(kept, F.col(row) == F.col(name), "left").withColumn("text", F.coalesce(text, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(chars, "n_chars").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
