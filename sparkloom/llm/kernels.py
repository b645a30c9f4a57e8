"""Vectorised passes over the bytes of whole Arrow batches of texts.

Each kernel walks a batch in pieces of a few megabytes (a longer text is a piece of its own),
so a worker holds a small multiple of one piece and not of the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _random.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
PLACE_CODE = _random.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def trim() -> None:
    """Give freed memory back to the system: idle workers stay for a while beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result hangs on every bit of the input."""
    h = h ^ (h >> np.uint64(30))
    h *= _B
    h ^= h >> np.uint64(27)
    h *= _C
    h ^= h >> np.uint64(31)
    return h


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, stop, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop
    trim()


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that no text boundary interrupts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    lengths = ends - starts
    total = int(lengths.sum())
    if not total:
        return mix(np.zeros(len(starts), np.uint64))
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    code = BYTE_CODE[data[np.repeat(starts, lengths) + place]] * PLACE_CODE[place & 4095]
    far = place >> 12  # spans of more than 4096 bytes: another multiplier for each 4096
    if far.any():
        code *= mix(far.astype(np.uint64)) | np.uint64(1)
    sums = np.zeros(len(starts), np.uint64)
    full = lengths > 0
    sums[full] = np.add.reduceat(code, first[full])
    return mix(sums + lengths.astype(np.uint64) * _A)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (with a closing entry)."""
    starts, ends = runs(~IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text its sorted distinct shingles of ``width`` words as hashes, A-Z lowered.

    Of a text with fewer words, the whole sequence is the only shingle.
    """
    data = LOWER[data]
    starts, ends, at = words(data, offsets)
    h = span_hashes(data, starts, ends)
    runs_of = [mix(h ^ _A)]  # by number of words, from each word on
    for n in range(1, width):
        runs_of.append(mix(runs_of[-1][:-1] * _A + (h[n:] ^ _C)) if len(h) > n else np.zeros(0, np.uint64))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = min(width, b - a)
        out.append(np.unique(runs_of[n - 1][a : b - n + 1]) if n else np.zeros(0, np.uint64))
    return out
