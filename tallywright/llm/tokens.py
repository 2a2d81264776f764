"""Encoding of texts with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this family of tokenizers splits a text into words before merging.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Characters of text encoded at once, and words remembered by a worker before it starts anew.
CHUNK_CHARS, REMEMBERED = 2_000_000, 400_000


class Vocabulary:
    """The merges as sorted pair keys (left id * size + right id) with the merged ids, which are also the ranks."""

    def __init__(self, state: dict):
        self.__dict__ |= state

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as file:
            ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        size = max(ids.values()) + 1
        pairs = {}
        for token, rank in ids.items():
            for at in range(1, len(token)):
                left, right = ids.get(token[:at]), ids.get(token[at:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
        keys = np.array(sorted(pairs), "i8")
        # none is a rank above all
        return cls({"size": size, "none": size, "bytes": np.array([ids[bytes([b])] for b in range(256)], "i8"), "keys": keys, "merged": np.array([pairs[k] for k in keys.tolist()], "i8")})

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair the merged id, found by binary search, or the rank above all."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one flat array, and how many each word has. No word is empty.

        Rounds over the symbols of all words at once: in each word the pair of lowest rank is merged
        wherever it stands, from the left. A word without a pair to merge drops out.
        """
        sizes = np.fromiter(map(len, words), "i8", len(words))
        symbols = self.bytes[np.frombuffer(b"".join(words), "u1")]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), self.none)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.ranks(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.append(True, ~same))
            counts = np.diff(np.append(starts, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), counts)
            active = lowest < self.none
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank, lowest = symbols[active], word[active], rank[active], lowest[active]
                if not len(symbols):
                    break
            hit = rank == lowest
            # in a run of neighbouring hits (a pair of equal symbols repeated) every second one counts
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.append(True, np.diff(at) > 1))
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            symbols[at] = rank[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        flat, owner = np.concatenate(done_symbols or [np.zeros(0, "i8")]), np.concatenate(done_words or [np.zeros(0, "i8")])
        order = np.argsort(owner, kind="stable")
        return flat[order].astype("i4"), np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes texts; words met before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(WORDS).findall
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, "i4"), np.zeros(0, "i8"), np.zeros(0, "i8")

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self.vocabulary.merge([w.encode("utf-8", "surrogatepass") for w in words])
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one flat array, and how many each text has."""
        words, counts = [], np.zeros(len(texts), "i8")
        for n, text in enumerate(texts):
            own = self.split(text)
            counts[n] = len(own)
            words += own
        if len(self.slots) > REMEMBERED:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.slots]
        if new:
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new)), strict=True))
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, words), "i8", len(words))
        sizes = self.sizes[slot]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[slot] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        of_text = np.add.reduceat(np.append(sizes, 0), np.minimum(np.cumsum(counts) - counts, len(sizes))) if len(texts) else counts
        return flat, np.where(counts > 0, of_text, 0)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of some CHUNK_CHARS characters."""
    start = chars = 0
    for n, text in enumerate(texts):
        chars += len(text)
        if chars >= CHUNK_CHARS:
            yield start, n + 1
            start, chars = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, lengths_only: bool = False) -> DataFrame:
    """Rows (id, ids) with each text's token ids as array<int>, or (id, n_tokens) with lengths_only.

    Special tokens' strings in a text are ordinary text. Texts are encoded whole, in batches: the
    words of a batch are told apart, and the merges of all words not met before run together.

    Defined cases: null and empty texts have no ids (an empty array, 0 tokens); rows repeat as often
    as they come; a null id is kept; an empty table gives no rows; further columns are ignored. The
    vocabulary is read once on the driver and broadcast; its size is that of the file, some MB.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(Vocabulary.read(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                flat, sizes = encoder.encode(texts[a:b])
                if lengths_only:
                    out = pa.array(sizes, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype("i4")), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out], names=[id_col, "out"])

    kind = dict(df.dtypes)[id_col]
    name = "n_tokens" if lengths_only else "ids"
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, out {'bigint' if lengths_only else 'array<int>'}").select(id_col, F.col("out").alias(name))


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (id, bytes) with the UTF-8 bytes that token ids stand for: of encode()'s ids the text's own.

    Defined cases: null and empty arrays give no bytes (an empty value); an id that the vocabulary
    doesn't have, and a null one, is an error.
    """
    with open(vocabulary, "rb") as file:
        tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    size = np.array([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)], "i8")
    shared = df.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(size))), "u1"), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, sizes = shared.value
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.dtype.kind == "f" or ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
                raise ValueError("an id that the vocabulary doesn't have")
            ids = ids.astype("i8")
            own = sizes[ids]
            flat = content[np.repeat(starts[ids] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            ends = np.append(0, np.cumsum(own))[np.append(0, np.cumsum(counts))].astype("i4")
            out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[id_col, "bytes"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, bytes binary")
