"""Words and shingles of Arrow text columns as numpy arrays; no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time (a longer text is one piece).
PIECE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keys(n: int, salt: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit multipliers."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    return mix(base) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(raw: np.ndarray, offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = high


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word: runs of anything but ASCII white space within a row."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = inside[1:] & (~inside[:-1] | edge)
    ends = inside[:-1] & (~inside[1:] | edge)
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends), np.searchsorted(offsets, start, "right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit multilinear hashes of words, A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.arange(int(size.sum())) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    place = at - np.repeat(start, size)
    value = (_LOWER[raw[at]] if lower else raw[at]).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        value *= keys(int(size.max()), 0x51ED27)[place]
        total = np.add.reduceat(value, np.concatenate(([0], np.cumsum(size)[:-1])))
        return mix(total + size.astype(np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct ``n``-word shingles of each row, sorted by row and hash.

    A row with fewer words has its whole sequence as its only shingle; one
    without words has none.
    """
    start, end, row = words(raw, offsets)
    hashed = word_hashes(raw, start, end)
    if not len(hashed):
        return row, hashed
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    weight = keys(n, 0xC0FFEE)
    with np.errstate(over="ignore"):
        padded = np.concatenate((hashed, np.zeros(n, np.uint64)))
        total = np.zeros(len(hashed), np.uint64)
        place = np.arange(len(hashed)) - first[row]
        for k in range(n):
            here = place + k < count[row]
            total += np.where(here, padded[k : k + len(hashed)] * weight[k], np.uint64(0))
        length = np.minimum(count[row], n)
        value = mix(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    full = (place + n <= count[row]) | ((place == 0) & (count[row] < n))
    row, value = row[full], value[full]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]
