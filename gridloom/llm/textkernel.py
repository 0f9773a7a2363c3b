"""Words of many texts at once, as NumPy arrays over the texts' bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D within one text. No
Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridloom.llm.token_counts import byte_slices

#: Bytes of text that a worker holds as arrays at once; a longer text goes alone.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x + np.uint64((salt * 2 + 1) * _BASE & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


@dataclass
class Words:
    """data: the words' bytes without space; word i is data[bounds[i]:bounds[i+1]].

    first: each text's first word; text t has words first[t]:first[t+1].
    """

    data: np.ndarray
    bounds: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.bounds) - 1
        if not n:
            return np.zeros(0, np.uint64)
        lengths = np.diff(self.bounds)
        place = np.arange(len(self.data)) - np.repeat(self.bounds[:-1], lengths)
        terms = _power_table(int(lengths.max()) + 1)[place] * (self.data.astype(np.uint64) + np.uint64(1))
        return mixed(np.add.reduceat(terms, self.bounds[:-1]) + lengths.astype(np.uint64))

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space after each, and where each begins there."""
        n = len(self.bounds) - 1
        lengths = np.diff(self.bounds)
        out = np.full(len(self.data) + n, 0x20, np.uint8)
        out[np.arange(len(self.data)) + np.repeat(np.arange(n), lengths)] = self.data
        return out, self.bounds + np.arange(n + 1)

    def dictionary(self) -> pa.DictionaryArray:
        """The words by their numbers among the distinct words."""
        n = len(self.bounds) - 1
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(self.bounds.astype(np.int64)), pa.py_buffer(self.data)]
        ).dictionary_encode()

    def codes(self) -> np.ndarray:
        """Equal words, and only those, get equal numbers."""
        return self.dictionary().indices.to_numpy()


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words of an Arrow array of strings or binaries; null is empty."""
    column = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    held = np.concatenate([[0], np.cumsum(inside)]) if len(data) else np.zeros(1, np.int64)
    bounds = np.append(held[starts], held[-1]).astype(np.int64)
    return Words(np.ascontiguousarray(data[inside]), bounds, np.searchsorted(starts, offsets))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours of ``h`` (empty where too few)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, size, power, length = None, 0, h, 1
    while True:
        if n & length:
            take = len(h) - (size + length) + 1
            out = power[:take].copy() if out is None else mixed(out[:take] * np.uint64(0xD6E8FEB86659FD93) + power[size : size + take], size + length)
            size += length
        if 2 * length > n:
            return out
        m = len(power) - length
        power = mixed(power[:m] * np.uint64(0xA0761D6478BD642F) + power[length : length + m], 64 + length)
        length *= 2


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``most`` bytes of text, or single longer rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for a, b in byte_slices(sizes, most):
        yield batch.slice(a, b - a)
