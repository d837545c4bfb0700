"""Vectorised text helpers: words, hashes of words, windows and substrings.

All of them work on the UTF-8 buffer of an Arrow string column, so that a task handles
millions of words without a Python object for each. A word is a maximal run of bytes
other than space and 0x09-0x0D; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes handled at once inside a task; bounds the memory of the arrays below.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                step = np.full(n, _BASE, U64)
                step[0] = 1
                self.up = np.multiply.accumulate(step)
                step[1:] = U64(_INVERSE)
                self.down = np.multiply.accumulate(step)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums for substring_hash; one longer than the values."""
    up, _ = _POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * up[: len(values)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal contents wherever they stand."""
    _, down = _POWERS.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of a block of documents: byte positions, and the first word of each document."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The index of each word's document."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return substring_hash(rolling(self.data.astype(np.uint16) + 1), self.start, self.end)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets (nulls are empty)."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(column: pa.Array) -> Words:
    data, offsets = buffers(column)
    return words_of(data, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    gap = _SEPARATOR[data]
    begin = ~gap
    stop = ~gap
    begin[1:] &= gap[:-1]
    stop[:-1] &= gap[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] |= ~gap[edges]
    stop[edges - 1] |= ~gap[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def window_hash(prefix: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Hashes of width consecutive values that start at each of first."""
    return substring_hash(prefix, first, first + width)


def blocks(batch: pa.RecordBatch, text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about size bytes of the text column (one row at least)."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, np.cumsum(lengths)
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
