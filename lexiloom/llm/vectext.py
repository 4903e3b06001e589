"""Whole Arrow batches of texts as flat byte arrays, with vectorised word hashing.

All helpers look at complete texts. ``slices`` only groups rows so that the working arrays of
one step stay small; it never cuts a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text whose hashes are in memory at once, save for a single longer text.
SLICE_BYTES = 1 << 19
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

#: Whether a byte is white space in the class [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes each; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + target, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def give_back() -> None:
    """Return free memory to the system: a worker that waits for its next task holds little then."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of a flat batch and the row it belongs to."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separators[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    starts_of_rows = offsets[:-1][offsets[:-1] < len(raw)]
    first[starts_of_rows] = True
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[starts_of_rows[starts_of_rows > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        base, inverse = np.full(size, BASE, U64), np.full(size, BASE_INV, U64)
        base[0] = inverse[0] = 1
        _POW, _INV = np.cumprod(base), np.cumprod(inverse)
    return _POW, _INV


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:end], which depends on its bytes alone."""
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_VALUE[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each n-word shingle of the lower-cased texts, and the words of each row.

    A text with fewer than n words (but at least one) has its whole sequence as the only shingle.
    """
    lowered = LOWER[raw]
    starts, ends, rows = words(lowered, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    h = span_hashes(lowered, starts, ends)
    if not len(h):
        return h, rows, counts
    first = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=first[1:])
    position = np.arange(len(h)) - first[rows]
    total = mix(h + U64(1))
    available = counts[rows] - position
    for k in range(1, n):
        shifted = np.zeros_like(h)
        left = max(len(h) - k, 0)
        shifted[:left] = h[k : k + left]
        nxt = mix(total * U64(0xD6E8FEB86659FD93) + shifted + U64(k + 1))
        total = np.where(available > k, nxt, total)
    keep = (available >= n) | ((position == 0) & (counts[rows] < n))
    return total[keep], rows[keep], counts
