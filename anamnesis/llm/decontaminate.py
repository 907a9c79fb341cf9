"""Benchmark passages in documents, found with edits: q-gram lemma filter, then banded alignment.

Texts are compared with A-Z lower-cased and every run of white space as one space. An item of m
bytes matches a region if at most k = edit_share * m edits (insert, delete, replace a byte) turn
it into the region. Such a region shares at least m - q + 1 - k * q of the item's q-grams, and
they lie within k diagonals (text position minus item position). Shared q-grams are counted in
overlapping bands of 2k + 1 diagonals each, so that k diagonals always lie in one band; bands
that reach the bound are aligned within the band.

The items are read in blocks of bounded bytes. A block is a constant of the tasks, which stream
all documents past it; there is no join and no shuffle, so no document or passage is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.arrays import LOWER_ASCII, WHITE, mix, ragged_index, text_slices

Q = 8
EDIT_SHARE = 0.10
ITEM_BLOCK_BYTES = 4 << 20
ALIGNED_TOGETHER = 256
_FILTER_BITS = 22
SCHEMA = "doc_id long, item_id long, start long, end long, edits long, item_bytes long"


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, place of each byte in the given bytes): lower case, single spaces, none at the ends."""
    white = WHITE[data]
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[offsets] = True
    after_word = np.empty(len(data), dtype=bool)
    after_word[:1] = False
    after_word[1:] = ~white[:-1]
    keep = ~white | (after_word & ~starts[:-1])
    closing = np.zeros(len(data) + 1, dtype=bool)  # a space that only the end of the text follows
    place = np.flatnonzero(keep)
    row = np.searchsorted(offsets, place, side="right") - 1
    last = np.flatnonzero(np.diff(np.append(row, -1)) != 0)
    closing[place[last[white[place[last]]]]] = True
    place = place[~closing[place]]
    row = np.searchsorted(offsets, place, side="right") - 1
    out = LOWER_ASCII[data[place]]
    out[white[place]] = 32
    counts = np.bincount(row, minlength=len(offsets) - 1)
    return out, np.concatenate(([0], np.cumsum(counts))).astype(np.int64), place


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes (8 at most) from every place on, as one number."""
    count = len(data) - q + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    values = np.ndarray((count,), dtype="<u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    return values if q == 8 else values & np.uint64((1 << 8 * q) - 1)


class GramIndex:
    """The q-grams of some items, sorted."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray, q: int):
        self.q = q
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        values = grams(data, q)
        at = np.flatnonzero((row[:len(values)] == row[q - 1:]) & chosen[row[:len(values)]]) if len(values) else np.zeros(0, np.int64)
        at = at[np.argsort(values[at], kind="stable")]
        self.values, self.row, self.place = values[at], row[at], at - offsets[row[at]]
        self.different, self.first, self.count = np.unique(self.values, return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.slot(self.values)] = True

    @staticmethod
    def slot(values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


class Items:
    """One block of benchmark items with their q-grams.

    An item of L bytes may have e = floor(share * L) edits, which change at most e * q of its L - q + 1
    q-grams. Short items take a smaller q, so that at least one is always left.
    """

    def __init__(self, ids: list[int], texts: list[str], edit_share: float):
        column = pa.array(texts, pa.string())
        _, _, data, offsets = next(text_slices(column, 1 << 40))
        self.data, self.offsets, _ = normalise(data, offsets)
        self.ids = np.array(ids, dtype=np.int64)
        self.size = np.diff(self.offsets)
        self.edits = (edit_share * self.size).astype(np.int64)
        width = np.minimum(Q, self.size // (self.edits + 1))
        self.least = self.size - width + 1 - self.edits * width
        exact = (self.edits == 0) & (self.size < Q)
        self.indexes = [GramIndex(self.data, self.offsets, (width == q) & ~exact, int(q))
                        for q in np.unique(width[~exact & (self.size > 0)])]
        self.short = [(i, self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()) for i in np.flatnonzero((self.size > 0) & exact)]

    def find(self, text: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text row, item row, start, end, edits) of the best match in each place."""
        return [match for index in self.indexes for match in self._long(index, text, offsets)] + self._short(text, offsets)

    def _short(self, text, offsets):
        """Items of fewer than Q bytes that allow no edit."""
        found = []
        if self.short:
            for row in range(len(offsets) - 1):
                own = text[offsets[row]:offsets[row + 1]].tobytes()
                for item, wanted in self.short:
                    at = own.find(wanted)
                    while at >= 0:
                        found.append((row, item, at, at + len(wanted), 0))
                        at = own.find(wanted, at + len(wanted))
        return found

    def _long(self, index, text, offsets):
        values = grams(text, index.q)
        if not len(index.values):
            return []
        at = np.flatnonzero(index.filter[index.slot(values)])
        if not len(at):
            return []
        values = values[at]
        slot = np.minimum(np.searchsorted(index.different, values), len(index.different) - 1)
        known = index.different[slot] == values
        at, slot = at[known], slot[known]
        low, count = index.first[slot], index.count[slot]
        hit = ragged_index(low, count)
        at = np.repeat(at, count)
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + index.q <= offsets[row + 1]
        at, row, hit = at[inside], row[inside], hit[inside]
        item = index.row[hit]
        diagonal = at - offsets[row] - index.place[hit]
        step = step_of(self.edits, item)
        found = []
        band = diagonal // step
        keys = []
        for shift in (0, 1):
            keys.append(((row * np.int64(len(self.ids)) + item) << np.int64(32)) + (band - shift + (1 << 30)))
        keys = np.concatenate(keys)
        key, total = np.unique(keys, return_counts=True)
        wanted = total >= self.least[(key >> np.int64(32)) % len(self.ids)]
        if not wanted.any():
            return []
        # What counts is how many different q-grams of the item a band has, not how often each occurs.
        slot = np.minimum(np.searchsorted(key[wanted], keys), int(wanted.sum()) - 1)
        of_wanted = key[wanted][slot] == keys
        distinct = np.unique(slot[of_wanted] * (1 << 32) + np.tile(index.place[hit], 2)[of_wanted])
        key, total = key[wanted], np.bincount(distinct >> 32, minlength=int(wanted.sum()))
        pair, band = key >> np.int64(32), (key & np.int64(0xFFFFFFFF)) - (1 << 30)
        row, item = pair // len(self.ids), pair % len(self.ids)
        enough = total >= self.least[item]
        row, item, band = row[enough], item[enough], band[enough]
        order = np.argsort(self.size[item], kind="stable")
        for low in range(0, len(order), ALIGNED_TOGETHER):
            part = order[low:low + ALIGNED_TOGETHER]
            found += self._align(text, offsets, row[part], item[part], band[part] * step_of(self.edits, item[part]))
        return _best(found)

    def _align(self, text: np.ndarray, offsets: np.ndarray, row: np.ndarray, item: np.ndarray, first: np.ndarray):
        """Matches within the budget, all candidates at once: from `first`, two budgets of diagonals each.

        cost[c, d] is the least number of edits of the item's prefix that ends on diagonal
        low + d, and head[c, d] where its region starts.
        """
        edits, size = self.edits[item], self.size[item]
        base, length = offsets[row][:, None], np.diff(offsets)[row][:, None]
        low = (first - edits)[:, None]
        width = int(4 * edits.max() + 3)
        lanes = np.arange(width)[None, :]
        far = int(size.max()) + width + 1
        inside = lanes < (4 * edits + 3)[:, None]
        head = np.broadcast_to(low + lanes, inside.shape).copy()
        cost = np.where(inside & (head >= 0) & (head <= length), 0, far)
        edge = np.full((len(row), 1), far)
        final, final_head = np.full(inside.shape, far), head.copy()
        for step in range(int(size.max())):
            place = low + lanes + step
            valid = inside & (place >= 0) & (place < length)
            letter = text[np.where(valid, base + place, 0)]
            wanted = self.data[self.offsets[item] + np.minimum(step, size - 1)][:, None]
            moved = np.where(valid, cost + (letter != wanted), far)
            dropped = np.concatenate([cost[:, 1:], edge], axis=1) + 1
            better = dropped < moved
            moved = np.where(better, dropped, moved)
            moved_head = np.where(better, np.concatenate([head[:, 1:], edge], axis=1), head)
            packed = np.minimum.accumulate(((moved - lanes) << 20) + lanes, axis=1)  # an added byte moves along the row
            cost = np.where(inside & (place + 1 <= length), (packed >> 20) + lanes, far)
            head = np.take_along_axis(moved_head, packed & ((1 << 20) - 1), axis=1)
            ends = size == step + 1
            final[ends], final_head[ends] = cost[ends], head[ends]
        best = final.argmin(axis=1)
        here = np.arange(len(row))
        found = []
        for c in np.flatnonzero(final[here, best] <= edits):
            found.append((int(row[c]), int(item[c]), int(final_head[c, best[c]]),
                          int(low[c, 0] + best[c] + size[c]), int(final[c, best[c]])))
        return found


def step_of(edits: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Distance between bands of an item: two neighbouring bands cover two steps, so k diagonals lie in one."""
    return edits[item] + 1


def _best(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of matches of one item that overlap, the one with the fewest edits, then the first."""
    kept: dict[tuple[int, int], list] = {}
    for match in sorted(found, key=lambda m: (m[0], m[1], m[4], m[2], m[3])):
        own = kept.setdefault(match[:2], [])
        if all(match[3] <= other[2] or match[2] >= other[3] for other in own):
            own.append(match)
    return [m for own in kept.values() for m in own]


def _search(ids: list[int], texts: list[str], edit_share: float):
    made: list[Items] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Items(ids, texts, edit_share))
        items = made[0]
        names = ["doc_id", "item_id", "start", "end", "edits", "item_bytes"]
        for batch in batches:
            doc_ids, rows = batch.column(0), []
            for low, high, data, offsets in text_slices(batch.column(1)):
                text, own, place = normalise(data, offsets)
                # Code points before a byte: those bytes that continue none.
                matches = items.find(text, own)
                for r, i, start, end, edits in matches:
                    first, last = place[own[r] + start], place[own[r] + end - 1] + 1
                    head = data[offsets[r]:first]
                    body = data[first:last]
                    a = int(((head & 0xC0) != 0x80).sum())
                    rows.append((doc_ids[low + r].as_py(), int(items.ids[i]), a,
                                 a + int(((body & 0xC0) != 0x80).sum()), edits, int(items.size[i])))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, item_id, start, end (code points, end exclusive), edits, item_bytes: one row per match.

    Overlapping matches of one item count once, the one with the fewest edits. Null or blank
    items and texts match nothing; a null id stays null. Repeated rows give repeated matches.
    Other columns are ignored. An item of L normalised bytes matches with up to
    floor(edit_share * L) edits, so one of fewer than 1 / edit_share bytes must occur exactly.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")) \
        .where("item_id is not null and trim(text) <> ''").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // ITEM_BLOCK_BYTES))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    parts = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        run = _search([r.item_id for r in rows], [r.text for r in rows], edit_share)
        parts.append(source.where(F.lit(bool(rows))).mapInArrow(run, SCHEMA))
    return reduce(DataFrame.union, parts)
