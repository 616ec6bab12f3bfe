"""Language identification by hyperdimensional profiles.

Each letter of any script has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds those of its letters by multiplication,
the first rotated by two places, the second by one. A text's vector bundles (adds) those of its trigrams; a language's
prototype bundles the vectors, scaled to length 1, of the texts it is learned from. The language whose prototype has the
largest cosine with the text's vector is its language. All that isn't a letter counts as one blank.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.sampling import fold, labelled_texts

DIMENSIONS = 1024
#: The sample to learn from: rows of each language, and the longest piece of a text among them.
TRAIN_ROWS, TRAIN_BYTES = 600, 32_768
#: Characters bundled at once, texts times characters at once, and how sharply cosines become probabilities.
BATCH_CHARS, BATCH_CELLS, SHARPNESS = 1 << 18, 1 << 22, 60.0
#: Trigrams bound at once.
BOUND = 1 << 14
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = True
    return table


class Profiles:
    def __init__(self, seed: int = 5):
        self.seed = seed
        self.names: list[str] = []
        self.prototypes = np.zeros((0, DIMENSIONS), np.float32)
        self.prepare()

    def prepare(self) -> None:
        self.is_letter, self.known = _letters(), {}

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("seed", "names", "prototypes")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.prepare()

    def vector(self, letter: int) -> np.ndarray:
        """The random vector of a letter, drawn from its code point; of 0, the blank."""
        if letter not in self.known:
            if len(self.known) >= 1 << 13:
                self.known.clear()
            self.known[letter] = np.random.default_rng([self.seed, letter]).choice(np.array([-1, 1], np.int8), DIMENSIONS)
        return self.known[letter]

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The bundled vector of each text, and whether it has a letter."""
        low = [x.lower() for x in texts]
        codes = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(self.is_letter[np.minimum(codes, 0x10FFFF)], codes, 0)
        owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(x) + 1 for x in low])
        has = np.bincount(owner[codes > 0], minlength=len(low)) > 0
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        codes, owner = codes[keep], owner[keep]
        out = np.zeros((len(low), DIMENSIONS), np.float32)
        if len(codes) < 3:
            return out, has
        # The letters at hand by number: 0 is the blank.
        seen = np.zeros(0x110000, np.int32)
        seen[codes] = 1
        seen[0] = 1
        letters = np.flatnonzero(seen)
        seen[letters] = np.arange(len(letters))
        kinds, size = seen[codes].astype(np.int64), len(letters)
        grams, owner = (kinds[:-2] * size + kinds[1:-1]) * size + kinds[2:], owner[1:-1]
        used, place = np.unique(grams, return_inverse=True)
        table = np.array([self.vector(x) for x in letters.tolist()], np.int8)
        first, second = np.roll(table, 2, 1), np.roll(table, 1, 1)
        counts = np.bincount(owner.astype(np.int64) * len(used) + place, minlength=len(low) * len(used)).reshape(len(low), len(used)).astype(np.float32)
        for i in range(0, len(used), BOUND):
            g = used[i : i + BOUND]
            out += counts[:, i : i + BOUND] @ (first[g // size**2] * second[g // size % size] * table[g % size]).astype(np.float32)
        return out, has

    def fit(self, rows: list[tuple[str, str]]) -> "Profiles":
        sums: dict[str, np.ndarray] = {}
        for at in range(0, len(rows), 16):
            v, _ = self.vectors([t for t, _ in rows[at : at + 16]])
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            for x, (_, name) in zip(v, rows[at : at + 16]):
                sums[name] = sums.get(name, 0) + x
        self.names = sorted(sums)
        if sums:
            p = np.array([sums[k] for k in self.names], np.float32)
            self.prototypes = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        return self

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its part of the sharpened cosines of all."""
        names, scores, held, size = [], [], [], 0
        for text in [*texts, None]:
            if text is None or (held and (size + len(text) > BATCH_CHARS or (len(held) + 1) * (size + len(text)) > BATCH_CELLS)):
                v, has = self.whole(held)
                if self.names:
                    cosine = v @ self.prototypes.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    e = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
                    best = cosine.argmax(1)
                    names += [self.names[b] if h else UNKNOWN for b, h in zip(best, has)]
                    scores.append(np.where(has, e.max(1) / e.sum(1), 0.0))
                else:
                    names += [UNKNOWN] * len(held)
                    scores.append(np.zeros(len(held)))
                held, size = [], 0
            if text is not None:
                held.append(text)
                size += len(text)
        return names, np.concatenate(scores) if scores else np.zeros(0)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """vectors(); a long text is bundled piece by piece, pieces overlapping by two characters."""
        if len(texts) == 1 and len(texts[0]) > 2 * BATCH_CHARS:
            found = [self.vectors([texts[0][max(0, i - 2) : i + BATCH_CHARS]]) for i in range(0, len(texts[0]), BATCH_CHARS)]
            return np.sum([v for v, _ in found], axis=0), np.any([h for _, h in found], axis=0)
        return self.vectors(texts) if texts else (np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, bool))


def train(docs: DataFrame, per_language: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Profiles:
    rows = labelled_texts(docs, "lang", fold("doc_id", FOLDS) != HELD_OUT, per_language, most_bytes)
    return Profiles().fit(rows)


def identified(docs: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every row; null texts and those without a letter are `und`, with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        profiles = pickle.loads(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                names, scores = profiles.predict([x or "" for x in batch["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. A table without learnable rows gives `und` for all."""
    return identified(docs, train(docs)).select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
