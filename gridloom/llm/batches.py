"""Functions of Arrow batches: what workers give back, groups of rows, a union-find of one group."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(function: Callable) -> Callable:
    """``function`` of batches, whose worker gives its free memory back when it ends.

    Workers wait for more tasks beside the next stages.
    """

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch], *more) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches, *more)
        finally:
            trim()

    return run


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows of each key, whole; the input is sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        values = np.array(keys.to_pylist(), object) if pa.types.is_binary(keys.type) else keys.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != values[a]:
                yield _one(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y
