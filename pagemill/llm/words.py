"""Words of many texts at once, as numpy arrays of places and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 18  # bytes of text that are worked on at once; a longer text is its own chunk
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, which share their memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about ``most`` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def spans(data: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``of_word`` is true."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = of_word[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, equal for equal bytes."""
    power, inverse = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * power[: len(data)], out=total[1:])
    return scrambled((total[ends] - total[starts]) * inverse[starts])


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """hashes() of byte strings of their own."""
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
    return hashes(np.frombuffer(b"".join(keys), np.uint8), np.append(0, ends[:-1])[: len(keys)], ends)


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n adjacent words; the last n - 1 places have none."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    out = x[: len(x) - n + 1].copy()
    for i in range(1, n):
        out *= _U(0xD6E8FEB86659FD93)
        out += x[i : len(x) - n + 1 + i]
    return scrambled(out)
