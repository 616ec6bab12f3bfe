"""Encoding of whole texts by a tokenizer file, with the pieces of earlier words remembered.

A text is cut at ASCII white space, which the tokenizer's own splitting drops and never reaches across, and in words
between letters and signs; each distinct piece goes through the library once while it is remembered. Texts with control characters that only some engines call
white space, or with the marks of special tokens, are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from geosieve.llm.common import lean

#: A generation of remembered runs of letters or signs: when it is full, the one before it is dropped.
MOST_WORDS = 300_000
#: Bytes of text encoded together.
BATCH_BYTES = 6 << 20

ODD = bytes([*range(9), *range(28, 32), 127])
#: ASCII signs but for the apostrophe, which can open a suffix.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

_encoders: dict[str, "Encoder"] = {}


def _byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lean()
        self.lib = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size() <= 65536 else "<u4")
        self.letters = dict(enumerate(_byte_letters()))
        self.ids = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.lib.get_vocab_size())]
        normalizer, splits = str(self.lib.normalizer), str(self.lib.pre_tokenizer)
        #: Words may be taken alone (and in lower case) only where the file lowers case and splits at white space.
        self.by_word = "Lowercase" in normalizer and "s+" in normalizer and "Split" in splits and "ByteLevel" in splits
        #: Runs of letters, or of signs, may go to the model itself if it then answers as the whole library does.
        trial = [b"aftermath", b"zugekn\xc3\xb6pft", b"\xc3\xa0", b"***", b"$$%", b"qq", b"stra\xc3\x9fe"]
        self.by_part = self.by_word and all(self.of_model(x) == self.whole(x.decode()) for x in trial)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"": b""}
        self.old_parts = self.parts

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def of_model(self, raw: bytes) -> bytes:
        text = raw.decode() if raw.isascii() else raw.decode("latin-1").translate(self.letters)
        return b"".join([self.ids[t.id] for t in self.lib.model.tokenize(text)])

    def part(self, raw: bytes) -> bytes:
        """The ids of a run of letters, or of signs."""
        if (got := self.old_parts.get(raw)) is None:
            got = self.of_model(raw) if self.by_part else self.whole(raw.decode())
        if len(self.parts) >= MOST_WORDS:
            self.old_parts, self.parts = self.parts, {b"": b""}
        self.parts[raw] = got
        return got

    def odd(self, raw: bytes) -> bool:
        """Must be encoded whole."""
        return not self.by_word or b"<|" in raw or len(raw.translate(None, ODD)) < len(raw)

    def cores(self, raws: list[bytes]) -> list:
        """The ids of each run of letters; False for what isn't one (or for a tokenizer that doesn't allow it)."""
        out = [*map(self.parts.get, raws)]
        for i in [i for i, got in enumerate(out) if got is None]:
            raw = raws[i]
            if (got := self.old_parts.get(raw)) is None:
                got = self.of_model(raw) if self.by_part and (raw.isalpha() or LETTERS.fullmatch(raw)) else False
            if len(self.parts) >= MOST_WORDS:
                self.old_parts, self.parts = self.parts, {b"": b""}
            self.parts[raw] = out[i] = got
        return out

    def word(self, raw: bytes) -> bytes:
        """The ids of a word that isn't signs, letters, signs."""
        if (got := self.words.get(raw)) is None:
            if len(self.words) >= MOST_WORDS // 4:
                self.words.clear()
            got = self.words[raw] = self.whole(raw.decode())
        return got

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as UTF-8, end to end as int32, and how many each has.

        Arrow splits the texts and finds the distinct words, and of those the distinct runs of letters between signs;
        Python sees each of them once a batch.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        special = {i: np.frombuffer(self.whole(x.decode()), self.kind) for i, x in enumerate(texts) if self.odd(x)}
        column = pa.array([b"" if i in special else x for i, x in enumerate(texts)], pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(column))
        ends = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        core = pc.ascii_trim(distinct, characters=SIGNS.decode()).dictionary_encode()
        core_of, core_list = core.indices.to_numpy(zero_copy_only=False), core.dictionary.cast(pa.large_binary()).to_pylist()
        known = self.cores(core_list)
        unlike = np.array([x is False for x in known], bool)
        values = [known[k] for k in core_of.tolist()]
        longer = pc.binary_length(distinct).to_numpy(zero_copy_only=False) > pc.binary_length(core.dictionary).to_numpy(zero_copy_only=False)[core_of]
        rest = np.flatnonzero(longer | unlike[core_of])
        part = self.parts.get
        for i, word in zip(rest.tolist(), distinct.take(pa.array(rest)).cast(pa.large_binary()).to_pylist()):
            got, letters = values[i], core_list[core_of[i]]
            if got is False:
                values[i] = self.word(word)
            elif not letters:
                values[i] = self.part(word)
            elif word.startswith(letters):  # signs, letters, signs: the tokenizer splits exactly there
                signs = word[len(letters) :]
                values[i] = got + (part(signs) or self.part(signs))
            else:
                at = word.find(letters)
                signs = word[at + len(letters) :]
                values[i] = self.part(word[:at]) + got + (self.part(signs) if signs else b"")
        ids = np.frombuffer(b"".join(values), self.kind)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
        begins = np.cumsum(lengths) - lengths
        each = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        flat = ids[np.repeat(begins[codes] - upto[:-1], each) + np.arange(upto[-1])].astype(np.int32)
        bounds = upto[ends]
        if special:
            pieces = [special.get(i, flat[a:b]).astype(np.int32) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
            return np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        return flat, np.diff(bounds)

    def encode(self, raw: bytes) -> np.ndarray:
        """The ids of one text, as int32."""
        return self.encode_batch([raw])[0]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release() -> None:
    """Drops the tokenizers that this process remembers, with all pieces: 93 MB after 17,000 documents of check_s."""
    import gc

    if _encoders:
        _encoders.clear()
        gc.collect()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def texts_of(column) -> Iterator[bytes]:
    """UTF-8 of an Arrow string column's values; nulls are empty."""
    import pyarrow as pa

    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def batches_of(texts: list[bytes], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each."""
    begin, size = 0, 0
    for i, x in enumerate(texts):
        if i > begin and size + len(x) > most:
            yield begin, i
            begin, size = i, 0
        size += len(x)
    if begin < len(texts):
        yield begin, len(texts)
