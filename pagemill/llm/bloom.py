"""Bloom filters that all tasks of a scan build together.

Each task keeps two bit arrays (one bit a bit): of places set at least once, and of
places set by two or more entries.  It sends them cut into ``RANGES`` ranges, each
compressed, empty ones left out.  A range is merged piece by piece as it arrives, so
no task holds more than the ranges it merges: what two pieces both set once has been
set twice.  The merged filter has a fixed bound, ``1 << MOST`` bits, whatever the input;
a fuller filter lets more entries pass, and never loses one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

PROBES, RANGES = 2, 256
LEAST, MOST = 16, 26  # log2 of the bits of a filter
_U = np.uint64


def bits_for(entries: int) -> int:
    """log2 of the bits of a filter for so many entries: 8 to 16 bits each, within the bounds."""
    return min(MOST, max(LEAST, int(entries).bit_length() + 3))


def _places(hashes: np.ndarray, log2: int) -> np.ndarray:
    """One row of places for each probe."""
    x = np.stack([hashes * _U(0x9E3779B97F4A7C15), hashes * _U(0xC2B2AE3D27D4EB4F)][:PROBES])
    return ((x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)) >> _U(64 - log2)


def _set(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, (places >> _U(3)).astype(np.int64), np.left_shift(np.uint8(1), (places & _U(7)).astype(np.uint8)))


def _on(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[(places >> _U(3)).astype(np.int64)] >> (places & _U(7)).astype(np.uint8)) & 1 > 0


class Filter:
    """A merged filter; sent to tasks within their code."""

    def __init__(self, log2: int, bits: np.ndarray):
        self.log2, self.bits = log2, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return _on(self.bits, _places(hashes, self.log2)).all(axis=0)


class Seen:
    """What one task has seen."""

    def __init__(self, log2: int):
        self.log2 = log2
        self.once, self.twice = np.zeros(1 << (log2 - 3), np.uint8), np.zeros(1 << (log2 - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Add entries; equal hashes are entries of their own."""
        places, count = np.unique(_places(hashes, self.log2), return_counts=True)
        _set(self.twice, places[(count > 1) | _on(self.once, places)])
        _set(self.once, places)

    def parts(self) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        width = len(self.once) // RANGES
        for k in range(RANGES):
            once, twice = self.once[k * width : (k + 1) * width], self.twice[k * width : (k + 1) * width]
            if once.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(once.tobytes())]), pa.array([pack(twice.tobytes())])], ["part", "once", "twice"])


def built(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2: int, again: bool = False) -> Filter:
    """The filter of what ``hashes`` finds in the batches of ``rows``; with ``again``, of what came twice or more."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(log2)
        for batch in batches:
            for h in hashes(batch):
                seen.add(h)
        yield from seen.parts()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "twice")), strict=True):
                a, b = np.frombuffer(unpack(a), np.uint8), np.frombuffer(unpack(b), np.uint8)
                once, twice = state.get(k, (np.zeros_like(a), np.zeros_like(a)))
                state[k] = once | a, twice | b | (once & a)
        for k, found in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(found[again].tobytes())])], ["part", "bits"])

    parts = rows.mapInArrow(look, "part int, once binary, twice binary").repartition("part").mapInArrow(merge, "part int, bits binary")
    bits = np.zeros(1 << (log2 - 3), np.uint8)
    width = len(bits) // RANGES
    for r in parts.collect():  # RANGES rows, 1 << (log2 - 3) bytes in all
        bits[r.part * width : (r.part + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.bits)), np.uint8)
    return Filter(log2, bits)
