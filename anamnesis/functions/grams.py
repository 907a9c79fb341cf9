"""Trigrams of a batch of texts, in Arrow and numpy: what `text.trigrams` gives row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a code point.
POINT_BITS = 21
#: Bytes of text looked at together inside a task; one longer text is a piece by itself.
PIECE_BYTES = 1 << 20


def pieces(texts: pa.Array, most_bytes: int = PIECE_BYTES, most_rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, rows) of consecutive runs of texts of bounded size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        stop = min(max(int(np.searchsorted(ends, before + most_bytes, "right")), first + 1), first + most_rows, len(ends))
        yield first, stop - first
        first = stop


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every window of three characters of the folded texts; a key holds three code points."""
    low = pc.fill_null(pc.ascii_lower(texts), "")
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    within = row[:-2] == row[2:]
    keys = (points[:-2] << 2 * POINT_BITS) | (points[1:-1] << POINT_BITS) | points[2:]
    return row[:-2][within], keys[within]


def names_of(keys: np.ndarray) -> pa.Array:
    """The three characters of each key."""
    mask = (1 << POINT_BITS) - 1
    points = np.stack([keys >> 2 * POINT_BITS, (keys >> POINT_BITS) & mask, keys & mask], axis=1).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    return pa.array([text[i:i + 3] for i in range(0, len(text), 3)], pa.string())


def distinct_pairs(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, known): distinct pairs in order of row, `place` in the distinct keys `known`."""
    coded = pa.array(keys, pa.int64()).dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False)
    pair = np.sort(row * max(len(known), 1) + coded.indices.to_numpy(zero_copy_only=False))
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    return *np.divmod(pair, max(len(known), 1)), known


def trigram_lists(texts: pa.Array) -> pa.ListArray:
    """The distinct trigrams of each text; of a null text none."""
    row, place, known = distinct_pairs(*windows(texts))
    offsets = np.searchsorted(row, np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names_of(known).take(pa.array(place)))


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(memory_id, text) to (memory_id, grams), piece by piece."""
    for batch in batches:
        for first, rows in pieces(batch.column(1)):
            part = batch.slice(first, rows)
            yield pa.RecordBatch.from_arrays([part.column(0), trigram_lists(part.column(1))], ["memory_id", "grams"])
