"""Texts of an Arrow batch as numpy arrays: words, word hashes, hashes of word windows.

A word is a maximal run of bytes outside {space, \\t, \\n, \\v, \\f, \\r}; no byte of
a longer UTF-8 sequence is among these, so bytes give the same words as code
points do.  Everything is computed for a whole slice of a batch at once, and
slices are bounded in bytes (a single longer text is a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are turned into arrays at once.
SLICE_BYTES = 1 << 20

#: glibc's malloc_trim, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place: every input bit reaches every output bit."""
    x ^= x >> _S30
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def _table(seed: int) -> tuple[np.ndarray, np.uint64]:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 7919))
    table[_SPACE] = 0
    return table, np.uint64(0xD6E8FEB86659FD93 + 2 * seed)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most `limit` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(size), 0
    while first < n:
        base = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(first, stop - first)
        first = stop
    _give_back()


def _give_back() -> None:
    """Hands memory that is free to the system: workers wait for their next task beside others that run."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none) one after the other, and n + 1 offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """starts, ends: byte positions of all words; first: n + 1 positions in these, by text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.offsets = byte_view(texts)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(self.offsets), np.int64)
            return
        space = _SPACE[data]
        edge = np.empty(n + 1, bool)
        edge[1:], edge[0] = space, True
        inner = self.offsets[1:-1]
        edge[inner[inner < n]] = True
        self.starts = np.flatnonzero(edge[:-1] & ~space)
        edge[:-1], edge[-1] = space, True
        edge[inner] = True
        self.ends = np.flatnonzero(edge[1:] & ~space) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def count(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word: a polynomial of its bytes, mixed."""
        if not len(self):
            return np.zeros(0, np.uint64)
        table, base = _table(seed)
        lead = int(self.starts[0])
        place = np.arange(lead, len(self.data)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(self.data))))
        longest = int((self.ends - self.starts).max())
        powers = np.full(longest, base, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        terms = table[self.data[lead:]]
        terms *= powers[np.minimum(place, longest - 1)]
        return mix(np.add.reduceat(terms, self.starts - lead) + (self.ends - self.starts).astype(np.uint64))


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """For each i a hash of words[i : i + length], from hashes of runs of 1, 2, 4, ... words."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    out, power, have = None, words, 0
    size = 1
    while True:
        if length & size:
            if out is None:
                out, have = power, size
            else:
                n = len(words) - have - size + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = mix(out[:n] * odd + power[have : have + n])
                have += size
        if have == length:
            return out
        n = len(power) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        power = mix(power[:n] * odd + power[size : size + n] + np.uint64(size))
        size *= 2


def full(words: Words, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Positions of words (all, or of `at`) from which `length` words of the same text follow."""
    last = np.repeat(words.first[1:] - length, words.count)
    at = np.arange(len(words)) if at is None else at
    return at[at <= last[at]]


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of rows with a doc_id, the text as zstd (null: empty), for texts that are shuffled."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [len(raw := (t or "").encode()).to_bytes(8, "little") + codec.compress(raw, asbytes=True) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(compress, "doc_id long, text binary")


def plain(packed: pa.Array) -> pa.Array:
    """The texts that compressed() made."""
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in packed.to_pylist()], pa.binary()).cast(pa.string())
