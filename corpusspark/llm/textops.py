"""Vectorised word and character arrays of Arrow string columns, for the operators that count n-grams."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def give_back() -> None:
    """Hands a worker's freed memory back to the system. Workers go on to the next stage's tasks, and what the
    allocators keep of one stage would be missing in the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one
    if trim:
        trim(0)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[_LOWER]
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((_R, _R_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = 1_500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``size`` bytes; a row stays whole."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every slice of the bytes; equal slices have equal hashes anywhere."""
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def shingles(word_hash: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of k words; a row with 1 to k - 1 words has its whole sequence."""
    n = len(row)
    odd = [U64((2 * j + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1)) for j in range(k)]
    whole = np.zeros(n, dtype=U64)
    if n >= k:
        run = np.zeros(n - k + 1, dtype=U64)
        for j in range(k):
            run += word_hash[j:n - k + 1 + j] * odd[j]
        whole[:n - k + 1] = run
    full = np.zeros(n, dtype=bool)
    if n >= k:
        full[:n - k + 1] = row[:n - k + 1] == row[k - 1:]
    first = np.ones(n, dtype=bool)
    first[1:] = row[1:] != row[:-1]
    heads = np.flatnonzero(first)
    lengths = np.diff(np.append(heads, n))
    for at, length in zip(heads[lengths < k], lengths[lengths < k], strict=True):
        whole[at] = U64(sum((int(word_hash[at + j]) * int(odd[j]) for j in range(length)), int(length) << 7) & (2**64 - 1))
        full[at] = True
    return mix(whole[full]), row[full]
