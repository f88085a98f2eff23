"""Words, lines and rolling hashes of many texts at once, on raw bytes.

A block is a run of whole texts whose bytes lie one after another. Words are
the maximal runs of bytes outside space and 0x09-0x0D, which are also the
contracts' ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit polynomials taken from
prefix sums, so that any span costs the same, followed by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62, dtype=np.uint64)) * 8 + 5
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up = _powers_of(_BASE, BLOCK_BYTES + 1)
_down = _powers_of(_BASE_INV, BLOCK_BYTES + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_up):
        return _powers_of(_BASE, n), _powers_of(_BASE_INV, n)
    return _up[:n], _down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each codes[start:end]; codes are uint64."""
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[:-1], out=total[1:])
    length = (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix((total[ends] - total[starts]) * down[starts] + length)


def run_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive hashes, whatever the texts' bounds."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(size, dtype=np.uint64)
    for at in range(0, size, BLOCK_BYTES):
        starts = np.arange(min(BLOCK_BYTES, size - at))
        out[at : at + len(starts)] = span_hash(hashes[at : at + len(starts) + n - 1], starts, starts + n)
    return out


@dataclass
class Block:
    """Texts number ``first`` and following of a column: text i is data[offsets[i]:offsets[i+1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the range of its words."""
        return self.runs(~SPACE)

    def runs(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As words(), for the maximal runs of bytes of a kind (a mask of 256)."""
        n = len(self.data)
        if not n:
            empty = np.empty(0, dtype=np.int64)
            return empty, empty, np.zeros(len(self.offsets), dtype=np.int64)
        inside = kind[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = self.offsets[:-1]
        edges = edges[edges < n]
        first[edges] = inside[edges]
        edges = edges[edges > 0]
        last[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each data[start:end]; spans follow each other. A long text is hashed in parts of about BLOCK_BYTES."""
        if len(self.data) <= 2 * BLOCK_BYTES:
            return span_hash(_BYTE_CODE[self.data], starts, ends)
        out, at = np.empty(len(starts), dtype=np.uint64), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right")))
            first = starts[at]
            out[at:to] = span_hash(_BYTE_CODE[self.data[first : ends[to - 1]]], starts[at:to] - first, ends[at:to] - first)
            at = to
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The whole texts of a column in runs of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def full_runs(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which n words of one text start, and the range of them for each text."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    ranges = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(ranges[-1]) + np.repeat(bounds[:-1] - ranges[:-1], counts), ranges
