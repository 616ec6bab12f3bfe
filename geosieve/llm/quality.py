"""A byte-level convolutional network in numpy that scores the quality of whole texts.

Layers: a vector for each byte; learned filters over chunks of 8 bytes, one each 4 bytes, and filters over chunks of
32 bytes, one each 16, that see how many bytes equal the one `lag` before them (which tells repeated words); the
largest answer of each filter over all chunks of the text; a small dense layer; one probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.common import free_names, lean
from geosieve.llm.sampling import fold, labelled_texts
from geosieve.llm.tokens import texts_of

STRIDE, BLOCK = 4, 16
LAGS = tuple(range(2, 14))
#: The sample to learn from: rows of each label, and the longest piece of a text among them.
TRAIN_ROWS, TRAIN_BYTES = 1500, 16_384
#: Bytes scored at once.
BATCH_BYTES = 1 << 20
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


class Network:
    def __init__(self, seed: int = 7, embed: int = 8, filters: int = 24, lag_filters: int = 8, hidden: int = 16):
        rng = np.random.default_rng(seed)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        pooled = filters + lag_filters
        self.p = {
            "embed": normal(256, embed) * 8, "conv": normal(2 * STRIDE * embed, filters), "conv_b": np.zeros(filters, np.float32),
            "lag": normal(len(LAGS), lag_filters) * 2, "lag_b": np.zeros(lag_filters, np.float32),
            "dense": normal(pooled, hidden), "dense_b": np.zeros(hidden, np.float32), "out": normal(hidden, 1), "out_b": np.zeros(1, np.float32),
        }

    def layout(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one buffer, each padded with zeros to whole blocks and one more; where each begins, in blocks."""
        blocks = np.array([-(-len(x) // BLOCK) + 1 for x in texts])
        begins = np.concatenate([[0], np.cumsum(blocks)])
        return np.frombuffer(b"".join(x.ljust(int(b) * BLOCK, b"\0") for x, b in zip(texts, blocks)) + bytes(BLOCK), np.uint8), begins

    def answers(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk before pooling: by conv filters (a row each 4 bytes), by lag filters (a row each 16 bytes)."""
        p, half = self.p, self.p["conv"].shape[0] // 2
        x = p["embed"][buffer].reshape(len(buffer) // STRIDE, half)
        conv = (x @ p["conv"][:half])[:-1] + (x @ p["conv"][half:])[1:]
        conv = conv[: (len(buffer) - BLOCK) // STRIDE] + p["conv_b"]
        return conv, self.repeats(buffer) @ p["lag"] + p["lag_b"]

    def repeats(self, buffer: np.ndarray) -> np.ndarray:
        same = np.empty((len(buffer) // BLOCK, len(LAGS)), np.float32)
        for j, lag in enumerate(LAGS):
            equal = np.zeros(len(buffer), np.uint8)
            np.multiply(buffer[lag:] == buffer[:-lag], buffer[lag:] != 0, out=equal[lag:])
            same[:, j] = equal.reshape(-1, BLOCK).sum(1, dtype=np.uint8)
        return (same[:-1] + same[1:]) / (2 * BLOCK)

    def score(self, texts: list[bytes]) -> np.ndarray:
        p, out, held, size = self.p, [], [], 0
        for text in [*texts, None]:
            if text is None or (held and size + len(text) > BATCH_BYTES):
                pooled = self.pooled(held)
                hidden = np.maximum(pooled @ p["dense"] + p["dense_b"], 0)
                out.append(1 / (1 + np.exp(-np.clip((hidden @ p["out"])[:, 0] + p["out_b"], -30, 30))))
                held, size = [], 0
            if text is not None:
                held.append(text)
                size += len(text)
        return np.concatenate(out) if out else np.zeros(0)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The largest answers; a long text goes through piece by piece, whose chunks overlap, so memory is bounded."""
        if not texts:
            return np.zeros((0, self.p["dense"].shape[0]), np.float32)
        if len(texts) == 1 and len(texts[0]) > 2 * BATCH_BYTES:
            buffer, begins = self.layout(texts)
            last, step, parts = int(begins[1]), BATCH_BYTES // BLOCK, []
            for a in range(0, last, step):
                b, before = min(last, a + step), min(a, 1)  # chunks that begin in blocks a to b; a block before tells what repeats
                conv, lag = self.answers(buffer[(a - before) * BLOCK : (b + 1) * BLOCK])
                parts.append(np.hstack([conv[before * (BLOCK // STRIDE) :].max(0), lag[before:].max(0)]))
            return np.maximum(np.max(parts, axis=0), 0)[None]
        buffer, begins = self.layout(texts)
        conv, lag = self.answers(buffer)
        return np.maximum(np.hstack([np.maximum.reduceat(conv, begins[:-1] * (BLOCK // STRIDE)), np.maximum.reduceat(lag, begins[:-1])]), 0)

    def fit(self, rows: list[tuple[bytes, int]], epochs: int | None = None, batch: int = 32, rate: float = 4e-3, seed: int = 11) -> "Network":
        """Adam on the log loss; of each filter only the chunk with the largest answer learns."""
        rng, p = np.random.default_rng(seed), self.p
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        epochs = epochs or max(10, 600 * batch // len(rows))  # 600 steps at least
        step, half, n_conv = 0, p["conv"].shape[0] // 2, p["conv"].shape[1]
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                texts, labels = zip(*(rows[i] for i in order[at : at + batch]))
                buffer, begins = self.layout(texts)
                conv, lag = self.answers(buffer)
                lags = self.repeats(buffer)
                top_conv = np.array([a + conv[a:b].argmax(0) for a, b in zip(begins[:-1] * 4, begins[1:] * 4)])
                top_lag = np.array([a + lag[a:b].argmax(0) for a, b in zip(begins[:-1], begins[1:])])
                raw = np.hstack([np.take_along_axis(conv, top_conv, 0), np.take_along_axis(lag, top_lag, 0)])
                pooled = np.maximum(raw, 0)
                pre = pooled @ p["dense"] + p["dense_b"]
                hidden = np.maximum(pre, 0)
                z = (hidden @ p["out"])[:, 0] + p["out_b"]
                g = ((1 / (1 + np.exp(-z)) - np.array(labels)) / len(labels)).astype(np.float32)[:, None]
                d_hidden = (g @ p["out"].T) * (pre > 0)
                d_pooled = (d_hidden @ p["dense"].T) * (raw > 0)
                grad = {"out": hidden.T @ g, "out_b": g.sum(0), "dense": pooled.T @ d_hidden, "dense_b": d_hidden.sum(0)}
                d_conv, d_lag = d_pooled[:, :n_conv], d_pooled[:, n_conv:]
                grad["conv_b"], grad["lag_b"] = d_conv.sum(0), d_lag.sum(0)
                grad["lag"] = np.einsum("bfl,bf->lf", lags[top_lag], d_lag)
                codes = buffer[top_conv[:, :, None] * STRIDE + np.arange(2 * STRIDE)]  # text, filter, byte of the chunk
                grad["conv"] = np.einsum("bfk,bf->kf", p["embed"][codes].reshape(*top_conv.shape, 2 * half), d_conv)
                d_embed = np.einsum("bf,kf->bfk", d_conv, p["conv"]).reshape(-1, p["embed"].shape[1])
                grad["embed"] = np.zeros_like(p["embed"])
                np.add.at(grad["embed"], codes.ravel(), d_embed)
                step += 1
                for k, v in p.items():
                    m, s = moments[k]
                    m += 0.1 * (grad[k] - m)
                    s += 0.001 * (grad[k] ** 2 - s)
                    v -= (rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Network:
    """A network fitted on labels outside the held-out fold. Without labels of both kinds it answers about 1/2 or the one kind."""
    rows = labelled_texts(docs, "quality", fold("doc_id", FOLDS) != HELD_OUT, per_class, most_bytes, labels.select("doc_id", "quality"))
    data = [((t or "").encode(), int(y)) for t, y in rows]
    return Network().fit(data) if data else Network()


def scored(docs: DataFrame, model: Network, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`docs` with a score (0 to 1, higher: label 1 likelier) and a prediction (1 if score >= threshold), called `names`.

    Null and empty texts are scored as one chunk of zeros. Rows stay as they are, repeated ones and null doc_ids too; the
    table must have no columns called as `names`. An empty table gives no rows.
    """
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns already there: {', '.join(sorted(clash))}")
    weights = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = docs.select("*").schema.add(names[0], "double").add(names[1], "integer")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lean()
        net = pickle.loads(weights.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                scores = net.score([*texts_of(batch["text"])])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text the model accepts, with their own columns, whatever those are called."""
    score, predicted = free_names(docs.columns, "score", "predicted")
    return scored(docs, model, threshold, (score, predicted)).where(F.col(predicted) == 1).select(*docs.columns)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
