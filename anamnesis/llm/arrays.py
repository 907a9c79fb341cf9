"""Texts of an Arrow batch as numpy arrays: bytes, words and hashes, without a Python object per word.

Operators that run in Python tasks work on these. Memory is bounded by cutting a batch into
slices of whole texts (`slices`); a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_HASH_BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true in the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Space, and tab to carriage return: what separates words.
WHITE = byte_class((0x20, 0x20), (0x09, 0x0D))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    if data_buffer is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `most` bytes together, or one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each slice."""
    data, offsets = text_bytes(column)
    for low, high in slices(offsets, most):
        own = offsets[low:high + 1]
        yield low, high, data[own[0]:own[-1]], own - own[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the longest runs of true flags that stay within one text."""
    if not len(member):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before = np.empty(len(member), dtype=bool)
    before[0] = False
    before[1:] = member[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens = member & ~before
    opens[heads] = member[heads]
    after = np.empty(len(member), dtype=bool)
    after[-1] = False
    after[:-1] = member[1:]
    closes = member & ~after
    closes[heads[1:] - 1] = member[heads[1:] - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges (ascending, not overlapping, may be empty), by prefix sums modulo 2^64."""
    out = np.empty(len(start), dtype=np.uint64)
    low = 0
    while low < len(start):
        high = max(int(np.searchsorted(end, start[low] + _HASH_BLOCK, side="right")), low + 1)
        first, last = int(start[low]), int(end[high - 1])
        power = _powers(_BASE, last - first)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[data[first:last]] * power, out=sums[1:])
        a, b = start[low:high] - first, end[low:high] - first
        value = (sums[b] - sums[a]) * _powers(_BASE_INVERSE, last - first + 1)[a]
        out[low:high] = mix(value + (b - a).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        low = high
    return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, count: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < count:
        known = np.full(max(count, _HASH_BLOCK + 1), base, dtype=np.uint64)
        if len(known):
            known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if count <= _HASH_BLOCK + 1:
            _POWERS[int(base)] = known
    return known[:count]


def shingle_hashes(words: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of `width` words in a text; a shorter text is one shingle of all its words."""
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    total = len(words)
    value = np.full(total, np.uint64(width), dtype=np.uint64)
    place = np.arange(total) - np.repeat(first, counts)
    size = np.repeat(np.minimum(counts, width), counts)
    for step in range(width):
        reach = step < size
        at = np.minimum(np.arange(total) + step, max(total - 1, 0))
        value = np.where(reach, mix(value * np.uint64(0x9FB21C651E98DF25) + words[at]), value)
    keep = place <= np.repeat(counts, counts) - size
    return value[keep], row[keep]


def distinct_in_rows(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, row, offsets): each row's distinct values in ascending order."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    if len(values):
        keep = np.empty(len(values), dtype=bool)
        keep[0] = True
        keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[keep], row[keep]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int64)
    return values, row, offsets


def ragged_index(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated indexes start..start+length of every range."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(length) - length
    return np.arange(total) - np.repeat(shift - start, length)
