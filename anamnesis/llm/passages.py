"""Passages that repeat across documents, by compact windows of token hashes.

The tokens of a text are its shingles of `width` words. Two passages of at least the shortest
length and enough similarity share a run of tokens (`shared_run`): a place where they part costs
each at least `width` - 1 tokens, so few such places fit. With runs of `gram` tokens as units, the
Cartesian tree over the units' hashes gives every unit the largest window in which it is the
minimum; those windows are the runs of equal argmins of a sliding minimum, which is computed for
whole batches from prefix and suffix minima of blocks. A window as long as the shared run leaves
its minimum as a seed, so the two passages always have a seed in common. Every place is kept.

Texts with the same tokens are one text. Texts that share a seed are compared in whole: all their
common seeds, each exact run once. First the smallest text of a seed leads. Where a seed then
still holds several components, or places in no passage, its texts meet each other: pairwise where
they are few, else in blocks by leader, where texts with too few tokens in common around the seed
are told apart by matrix products, and places by a bound on what a range through them can reach. So
each open place is compared with every other component of its seed.

A passage is the widest stretch through an exact run, of matched tokens and small gaps, that is
similar enough on the full shingle sets; it is not rejected for looser surroundings.

Overlapping verified spans of a text are one passage; linked passages form a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.llm.arrays import LOWER_ASCII, WHITE, mix, range_hashes, runs, text_slices
from anamnesis.llm.components import connected_components
from anamnesis.session import cut_lineage

WIDTH = 5
PERCENT = 80
SHORTEST = 50
GAP = 10
PARTNERS_PER_BLOCK = 256
ALL_PAIRS = 32
BLOCK_TEXTS = 256
BLOCK_BYTES = 1 << 20


def token_hashes(column: pa.Array, width: int, most: int = 1 << 20):
    """(first row, end row, shingle hashes in order, row of each, first shingle of each row)."""
    for low, high, data, offsets in text_slices(column, most):
        data = LOWER_ASCII[data]
        start, end, row = runs(~WHITE[data], offsets)
        words = range_hashes(data, start, end)
        total = max(len(words) - width + 1, 0)
        value = np.full(total, np.uint64(width), dtype=np.uint64)
        for step in range(width):
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + words[step:step + total])
        inside = row[:total] == row[width - 1:] if total else np.zeros(0, bool)
        value, own = value[inside], row[:total][inside]
        first = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=high - low)))).astype(np.int64)
        yield low, high, value, own, first


def windows(value: np.ndarray, row: np.ndarray, least: int, function: int) -> np.ndarray:
    """Places that are the minimum of some window of `least` tokens inside one text."""
    count = len(value) - least + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    hashed = mix(value + np.uint64((function + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    bits = np.uint64(len(value).bit_length())
    packed = (hashed >> bits << bits) | np.arange(len(value), dtype=np.uint64)  # ties: the first
    padded = np.full(-(-len(value) // least) * least, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(value)] = packed
    blocks = padded.reshape(-1, least)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least_of = np.minimum(suffix[:count], prefix[least - 1:least - 1 + count])
    least_of = least_of[row[:count] == row[least - 1:]]
    if not len(least_of):
        return np.zeros(0, np.int64)
    fresh = np.ones(len(least_of), dtype=bool)
    fresh[1:] = least_of[1:] != least_of[:-1]
    return np.unique((least_of[fresh] & np.uint64((1 << int(bits)) - 1)).astype(np.int64))


def shared_run(width: int, least: int, percent: int) -> tuple[int, int]:
    """(tokens of the run that similar passages share, fewest tokens they share in all)."""
    fewest = -(-2 * percent * least // (100 + percent))
    run = least
    for size in range(least, 8 * least):
        parts = size * (100 - percent) // (max(width - 1, 1) * (100 + percent))
        run = min(run, -(-max(fewest, size - parts * (width - 1)) // (parts + 1)))
    return max(run, 1), fewest


def seeds(value: np.ndarray, own: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key): the minima of all windows of `run` tokens inside a text, over runs of `gram` tokens."""
    gram = max(1, run * 3 // 7)
    span = run - gram + 1
    count = max(len(value) - gram + 1, 0)
    inside = np.flatnonzero(own[:count] == own[gram - 1:]) if count else np.zeros(0, np.int64)
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.zeros(count, np.uint64)
    for step in range(gram):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + value[step:step + count])
    key = key[inside]
    at = windows(key, own[inside], span, 0)
    if len(at) > 1:  # a short period gives one key again and again: once per window is enough
        again = np.zeros(len(at), dtype=bool)
        again[1:] = (key[at[1:]] == key[at[:-1]]) & (np.diff(at) < span) & (own[inside[at[1:]]] == own[inside[at[:-1]]])
        at = at[~again]
    return inside[at], key[at]


def _signed(width: int, run_tokens: int):
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.string()), ("n", pa.int32()),
                        ("seeds", pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, value, own, first in token_hashes(batch.column(1), width):
                place, key = seeds(value, own, run_tokens)
                cut = np.searchsorted(own[place], np.arange(high - low + 1)) if len(place) else np.zeros(high - low + 1)
                shift = place - first[own[place]]
                inner = np.arange(len(value), dtype=np.uint64) - first[own].astype(np.uint64)
                total, other = np.zeros(high - low, np.uint64), np.zeros(high - low, np.uint64)
                np.add.at(total, own, mix(value + inner * np.uint64(0x632BE59BD9B4E019)))
                np.add.at(other, own, mix(value ^ mix(inner)))
                size = np.diff(first)
                names = [f"{n:x}.{x:016x}{y:016x}" for n, x, y in zip(size.tolist(), total.tolist(), other.tolist())]
                flat = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(shift.astype(np.int32))],
                                                  ["key", "place"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low).cast(pa.int64()), pa.array(names, pa.string()), pa.array(size.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), flat)], schema=schema)

    return run, "doc_id long, copy string, n int, seeds array<struct<key:long,place:int>>"


def _gaps(places: np.ndarray) -> np.ndarray:
    """Which of the places has more than GAP unmatched ones behind it."""
    return np.flatnonzero(places[1:] - places[:-1] > GAP + 1)


def _region(places: np.ndarray, gaps: np.ndarray, at: int) -> tuple[int, int]:
    """[low, high): around `at`, the matched places with gaps of at most GAP unmatched ones."""
    gap = int(gaps.searchsorted(places.searchsorted(at)))
    low = places[gaps[gap - 1] + 1] if gap else places[0]
    high = places[gaps[gap]] if gap < len(gaps) else places[-1]
    return int(low), int(high) + 1


class Text:
    """A text's tokens and its seeds in the order of their keys."""

    def __init__(self, tokens: np.ndarray, place: np.ndarray, key: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.tokens, self.place, self.key = tokens, place[order], key[order]


def _texts(column: pa.Array, width: int, run_tokens: int) -> Iterator[tuple[int, Text]]:
    for low, high, value, own, first in token_hashes(column, width):
        place, key = seeds(value, own, run_tokens)
        cut = np.searchsorted(own[place], np.arange(high - low + 1)) if len(place) else np.zeros(high - low + 1, np.int64)
        for i in range(high - low):
            at = slice(cut[i], cut[i + 1])
            yield low + i, Text(value[first[i]:first[i + 1]].copy(), place[at] - first[i], key[at])


def _earlier(numbers: np.ndarray) -> np.ndarray:
    """Which places hold a token that stands before them, too."""
    again = np.ones(len(numbers), dtype=bool)
    again[np.unique(numbers, return_index=True)[1]] = False
    return again


def _scores(held: np.ndarray, again: np.ndarray, at: np.ndarray, least: int, percent: int) -> np.ndarray:
    """How similar a range through each of the places `at` (rows) can be, for each of several other texts (columns).

    held: which tokens (rows) the other texts have; again: tokens that stand before, too. Similar ranges with c common of m
    and n distinct tokens have (100 + percent) * 2c >= 2 * percent * (m + n), so the scores of their places in both texts
    add up to 0 or more: each is the largest sum over a long enough range, of 100 - percent for a token that is held and
    -2 * percent for one that is not; a repeated one that is not held counts nothing. No similar ranges are lost.
    """
    size, others = held.shape
    low = np.iinfo(np.int32).min // 4
    if size < least or not len(at):
        return np.full((len(at), others), low, np.int32)
    sums = np.zeros((size + 1, others), np.int32)
    np.cumsum(held * np.int32(100 - percent) - (~held & ~again[:, None]) * np.int32(2 * percent), axis=0, out=sums[1:])
    best = np.maximum.accumulate(sums[::-1], axis=0)[::-1]  # the largest sum from here on
    most = np.full((size + least, others), low, np.int32)  # of the least length and more, by start
    np.subtract(best[least:], sums[:size + 1 - least], out=most[least:size + 1])
    wide = 1
    while wide < least:  # the largest of the last `least` starts
        step = min(wide, least - wide)
        most[step:] = np.maximum(most[step:], most[:-step])
        wide += step
    far = best[at + 1] - np.minimum.accumulate(sums, axis=0)[np.maximum(at - least, 0)]
    return np.maximum(most[at + least], np.where(at[:, None] >= least, far, low))


def _back(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """Equal tokens before (x, y)."""
    step, at = 64, 0
    while True:
        size = min(x - at, y - at, step)
        if size <= 0:
            return at
        other = (a[x - at - size:x - at] != b[y - at - size:y - at])[::-1]
        first = int(other.argmax())
        if other[first]:
            return at + first
        at, step = at + size, step * 4


class Pair:
    """Two texts; finds their similar passages.

    Their tokens are numbered once, so that what two ranges share is looked up and counted without a sort.
    """

    def __init__(self, one: Text, two: Text, least: int, percent: int):
        self.one, self.two = one, two
        self.a, self.b, self.least, self.percent = one.tokens, two.tokens, least, percent
        both = np.concatenate([self.a, self.b])
        order = np.argsort(both, kind="stable")
        fresh = np.append(True, both[order[1:]] != both[order[:-1]])[:len(both)]
        number, before, size = np.empty(len(both), np.int64), np.full(len(both), -1), len(self.a)
        number[order] = np.cumsum(fresh) - 1
        again = np.flatnonzero(~fresh[1:] & ((order[1:] < size) == (order[:-1] < size)))
        before[order[again + 1]] = order[again] - np.where(order[again] < size, 0, size)
        self.one_number, self.two_number = number[:size], number[size:]
        self.one_before, self.two_before = before[:size], before[size:]  # the place before with the same token
        self.one_list, self.two_list = self.one_number.tolist(), self.two_number.tolist()
        self.found = np.zeros(len(both), dtype=bool)
        self.after: dict[tuple[int, int, bool], tuple[int, int, int] | None] = {}
        self.places: list[tuple[np.ndarray, np.ndarray]] | None = None

    def _held(self, numbers: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of the numbers are among the others."""
        self.found[others] = True
        held = self.found[numbers]
        self.found[others] = False
        return held

    def passages(self) -> list[tuple[int, int, int, int]]:
        """(start and end in a, start and end in b) of all of them."""
        low = np.searchsorted(self.two.key, self.one.key, side="left")
        high = np.searchsorted(self.two.key, self.one.key, side="right")
        done: list[tuple[int, int, int, int]] = []
        tried: dict[int, list[tuple[int, int]]] = {}  # by diagonal: exact runs that were looked at
        hits = np.flatnonzero(high > low)
        for at in hits[np.argsort(self.one.place[hits], kind="stable")].tolist():
            x, others = int(self.one.place[at]), self.two.place[low[at]:high[at]]
            inside = [span for span in done if span[0] <= x < span[1]]
            for span in inside:
                others = others[(others < span[2]) | (others >= span[3])]
            for y in others.tolist():
                if any(s <= x < e and t <= y < f for s, e, t, f in done):
                    continue
                if any(s <= x < e for s, e in tried.get(x - y, ())):
                    continue
                left, right = self._back(x, y), self._run(x, y)
                tried.setdefault(x - y, []).append((x - left, x + right))
                span = self._passage(x - left, y - left, left + right)
                if span is not None:
                    done.append(span)
        return done

    def through(self, x: int, y: int) -> bool:
        """Whether a passage goes through the exact run at (x, y)."""
        left, right = self._back(x, y), self._run(x, y)
        return self._passage(x - left, y - left, left + right) is not None

    def _run(self, x: int, y: int) -> int:
        """Equal tokens from (x, y) on."""
        step, at = 64, 0
        while True:
            size = min(len(self.a) - x - at, len(self.b) - y - at, step)
            if size <= 0:
                return at
            other = self.a[x + at:x + at + size] != self.b[y + at:y + at + size]
            first = int(other.argmax())
            if other[first]:
                return at + first
            at, step = at + size, step * 4

    def _back(self, x: int, y: int) -> int:
        return _back(self.a, self.b, x, y)

    def _next(self, x: int, y: int, forward: bool) -> tuple[int, int, int] | None:
        """(start in a, start in b, length) of the nearest equal run over a small gap after the ends x and y.

        Runs of many diagonals lead to the same ends, so what follows an end is kept."""
        if (x, y, forward) not in self.after:
            self.after[x, y, forward] = self._search(x, y, forward)
        return self.after[x, y, forward]

    def _search(self, x: int, y: int, forward: bool) -> tuple[int, int, int] | None:
        if forward:
            one, two = self.one_list[x:x + GAP + 1], self.two_list[y:y + GAP + 1]
        else:
            one, two = self.one_list[max(x - GAP - 1, 0):x][::-1], self.two_list[max(y - GAP - 1, 0):y][::-1]
        near = 2 * GAP + 1
        for at, token in enumerate(one):
            if at >= near:
                break
            if token in two and at + two.index(token) < near:
                i, j = at, two.index(token)
                near = i + j
        if near > 2 * GAP:
            return None
        if forward:
            return x + i, y + j, self._run(x + i, y + j)
        size = self._back(x - i, y - j)
        return x - i - size, y - j - size, size

    def similar(self, s: int, e: int, t: int, f: int) -> bool:
        if min(e - s, f - t) < self.least:
            return False
        first = self.one_before[s:e] < s  # each token once
        common = int(np.count_nonzero(self._held(self.one_number[s:e], self.two_number[t:f]) & first))
        sizes = int(np.count_nonzero(first)) + int(np.count_nonzero(self.two_before[t:f] < t))
        return 100 * common >= self.percent * (sizes - common)

    def _padded(self, s: int, e: int, size: int) -> tuple[int, int]:
        """The range, brought to the least length with the tokens after it, or before it at the text's end."""
        e = min(max(e, s + self.least), size)
        return max(min(s, e - self.least), 0), e

    def _passage(self, x: int, y: int, size: int) -> tuple[int, int, int, int] | None:
        """The widest similar passage found through the exact run."""
        if min(len(self.a), len(self.b)) < self.least:
            return None
        whole = self._whole(x, y)
        if whole is not None:
            return whole
        ahead, back = [(x, y, size)], [(x, y, size)]
        while (run := self._next(ahead[-1][0] + ahead[-1][2], ahead[-1][1] + ahead[-1][2], True)) is not None:
            ahead.append(run)
        while (run := self._next(back[-1][0], back[-1][1], False)) is not None:
            back.append(run)
        ahead, back = np.array(ahead), np.array(back)
        end_a, end_b, more = ahead[:, 0] + ahead[:, 2], ahead[:, 1] + ahead[:, 2], np.cumsum(ahead[:, 2])
        before = np.cumsum(back[:, 2]) - size
        for lo, hi in self._widest(end_a, end_b, more, back, before):
            s, e = self._padded(int(back[lo, 0]), int(end_a[hi]), len(self.a))
            t, f = self._padded(int(back[lo, 1]), int(end_b[hi]), len(self.b))
            if self.similar(s, e, t, f):
                return s, e, t, f
        return (x, x + size, y, y + size) if size >= self.least else None

    def _widest(self, end_a, end_b, more, back, before) -> Iterator[tuple[int, int]]:
        """(first run, last run) whose equal tokens are enough, the longest first."""
        for low in range(0, len(back), 256):
            part = slice(low, low + 256)
            one = np.maximum(end_a[None, :] - back[part, 0, None], self.least)
            two = np.maximum(end_b[None, :] - back[part, 1, None], self.least)
            common = more[None, :] + before[part, None]
            lo, hi = np.nonzero(100 * common >= self.percent * (one + two - common))
            for k in np.argsort(-common[lo, hi], kind="stable").tolist():
                yield low + int(lo[k]), int(hi[k])

    def _whole(self, x: int, y: int) -> tuple[int, int, int, int] | None:
        """The region of matched tokens, in any order, narrowed to what the other side holds."""
        a, b = self.one_number, self.two_number
        if self.places is None:
            held = np.flatnonzero(self._held(a, b)), np.flatnonzero(self._held(b, a))
            self.places = [(places, _gaps(places)) for places in held]
        (low_a, high_a), (low_b, high_b) = _region(*self.places[0], x), _region(*self.places[1], y)
        while min(high_a - low_a, high_b - low_b) >= self.least:
            if self.similar(low_a, high_a, low_b, high_b):
                return low_a, high_a, low_b, high_b
            before = low_a, high_a, low_b, high_b
            held = np.flatnonzero(self._held(a[low_a:high_a], b[low_b:high_b]))
            s, e = _region(held, _gaps(held), x - low_a)
            low_a, high_a = low_a + s, low_a + e
            held = np.flatnonzero(self._held(b[low_b:high_b], a[low_a:high_a]))
            s, e = _region(held, _gaps(held), y - low_b)
            low_b, high_b = low_b + s, low_b + e
            if before == (low_a, high_a, low_b, high_b):
                break
        return None


_LINK = "leader long, partner long, start_a long, end_a long, start_b long, end_b long"
_NAMES = [column.split()[0] for column in _LINK.split(", ")]


def _links(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def _verify(width: int, least: int, percent: int):
    """Rows sorted by (leader, block, kind): the leader's text, then its partners."""
    run_tokens, _ = shared_run(width, least, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            heads = batch.column("leader").to_pylist()
            ids, kinds = batch.column("doc_id").to_pylist(), batch.column("kind").to_pylist()
            out = []
            for i, text in _texts(batch.column("text"), width, run_tokens):
                if kinds[i] == 0:
                    leader, own = heads[i], text
                    continue
                if leader is None or leader != heads[i]:
                    raise ValueError("a partner came before its leader")
                for s, e, t, f in Pair(own, text, least, percent).passages():
                    out.append((leader, ids[i], s, e + width - 1, t, f + width - 1))
            yield _links(out)

    return run, _LINK


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: int, percent: int) -> DataFrame:
    """`pairs`: leader, partner, each pair once."""
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("partners"))
    blocks = F.ceil(F.col("partners") / PARTNERS_PER_BLOCK)
    members = pairs.join(sizes, "leader").select(
        F.col("partner").alias("doc_id"), "leader", F.pmod(F.xxhash64("partner"), blocks).cast("int").alias("block"),
        F.lit(1).alias("kind"))
    heads = sizes.select(F.col("leader").alias("doc_id"), "leader",
                         F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"), F.lit(0).alias("kind"))
    rows = texts.join(members.union(heads), "doc_id").select("doc_id", "text", "leader", "block", "kind")
    run, schema = _verify(width, least, percent)
    return rows.repartition("leader", "block").sortWithinPartitions("leader", "block", "kind").mapInArrow(run, schema)


def _near(held: list[Text], doc: np.ndarray, place: np.ndarray, reach: int) -> np.ndarray:
    """Tokens that the surroundings of the places have in common, pair by pair."""
    parts = [np.unique(held[d].tokens[max(p - reach, 0):p + reach]) for d, p in zip(doc.tolist(), place.tolist())]
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    _, column, spread = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    column = column.ravel()
    common = np.zeros((len(parts), len(parts)), dtype=np.float32)
    keep = spread[column] > 1
    row, (_, column) = row[keep], np.unique(column[keep], return_inverse=True)
    column = column.ravel()
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(parts), 4096), dtype=np.float32)
        part[row[x:y], column[x:y] - low] = 1
        common += part @ part.T
    return common


class Others:
    """How similar ranges through the places of a text can be to each other text of a meeting."""

    def __init__(self, held: list[Text], places: list[np.ndarray], least: int, percent: int):
        sizes = np.array([len(text.tokens) for text in held])
        _, number, spread = np.unique(np.concatenate([text.tokens for text in held]), return_inverse=True, return_counts=True)
        number = number.ravel()
        column = np.where(spread > 1, np.cumsum(spread > 1), 0)[number]  # a token that stands once is held by no other text
        self.has = np.zeros((int(column.max(initial=0)) + 1, len(held)), dtype=bool)
        self.has[column, np.repeat(np.arange(len(held)), sizes)] = True
        self.has[0] = False
        edges = np.cumsum(sizes)[:-1]
        self.column, self.again = np.split(column, edges), [_earlier(x) for x in np.split(number, edges)]
        self.places, self.least, self.percent = places, least, percent
        self.known: dict[int, np.ndarray] = {}

    def scores(self, text: int) -> np.ndarray:
        """Places of the text x other texts."""
        if text not in self.known:
            column = self.column[text]
            step = max((1 << 19) // max(len(column), 1), 1)
            self.known[text] = np.concatenate([
                _scores(self.has[column, low:low + step], self.again[text], self.places[text], self.least, self.percent)
                for low in range(0, self.has.shape[1], step)], axis=1)
        return self.known[text]


def _block_links(width: int, least: int, percent: int):
    """Rows sorted by meeting of two blocks; links between places that are not in one component."""
    run_tokens, fewest = shared_run(width, least, percent)

    def links(meeting, ids, sides, spans, opened, held) -> pa.RecordBatch:
        parent: list[int] = []
        named: dict[int, int] = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        node = []  # of each seed of each text
        for text, own in zip(held, spans):
            name = np.full(len(text.place), -1)
            for span in own or ():
                if span["node"] not in named:
                    named[span["node"]] = len(parent)
                    parent.append(len(parent))
                name[(text.place >= span["start"]) & (text.place < span["end"] - width + 1)] = named[span["node"]]
            bare = np.flatnonzero(name < 0)
            name[bare] = np.arange(len(parent), len(parent) + len(bare))
            parent += name[bare].tolist()
            node.append(name)
        own = [np.isin(text.key, keys) for text, keys in zip(held, opened)]
        key = np.concatenate([text.key[at] for text, at in zip(held, own)])
        doc = np.repeat(np.arange(len(held)), [np.count_nonzero(at) for at in own])
        place = np.concatenate([text.place[at] for text, at in zip(held, own)])
        flat = np.concatenate([name[at] for name, at in zip(node, own)])
        order = np.argsort(key, kind="stable")
        key, doc, place, flat = key[order], doc[order], place[order], flat[order]
        index = np.concatenate([np.arange(np.count_nonzero(at)) for at in own])[order]  # among the places of its text
        others = Others(held, [text.place[at] for text, at in zip(held, own)], least, percent)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, int)
        side, out, compared, failed = np.array(sides), [], set(), set()
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if high - low < 2 or doc[low] == doc[high - 1]:
                continue
            root = np.array([find(x) for x in flat[low:high].tolist()])
            if (root == root[0]).all():
                continue
            # Places are taken in parts, so that a text with very many of them makes no large matrix.
            for one in range(low, high, 512):
                for two in range(one, high, 512):
                    at = np.arange(one, min(one + 512, high))
                    if two != one:
                        at = np.concatenate([at, np.arange(two, min(two + 512, high))])
                    own, names = doc[at], root[at - low]
                    able = (own[:, None] < own[None, :]) & (names[:, None] != names[None, :])
                    if meeting[1] != meeting[2]:
                        able &= side[own][:, None] != side[own][None, :]
                    if not able.any():
                        continue
                    able &= _near(held, own, place[at], 2 * least) >= fewest
                    for i, j in zip(*(x.tolist() for x in np.nonzero(able))):
                        x, y = int(own[i]), int(own[j])
                        if (x, y) in compared or find(int(names[i])) == find(int(names[j])):
                            continue
                        if int(others.scores(x)[index[at[i]], y]) + int(others.scores(y)[index[at[j]], x]) < 0:
                            continue
                        s, t = int(place[at[i]]), int(place[at[j]])
                        run = x, y, t - s, s - _back(held[x].tokens, held[y].tokens, s, t)
                        if run in failed:
                            continue
                        pair = Pair(held[x], held[y], least, percent)
                        if not pair.through(s, t):  # alike elsewhere at most, which is found from the seeds there
                            failed.add(run)
                            continue
                        compared.add((x, y))
                        for s, e, t, f in pair.passages():
                            out.append((ids[x], ids[y], s, e + width - 1, t, f + width - 1))
                            joined = np.concatenate([node[x][(held[x].place >= s) & (held[x].place < e)],
                                                     node[y][(held[y].place >= t) & (held[y].place < f)]]).tolist()
                            for name in joined[1:]:
                                parent[find(name)] = find(joined[0])
        return _links(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("leader", "low", "high"))))
            ids, sides, spans = (batch.column(c).to_pylist() for c in ("doc_id", "block", "spans"))
            seeds_of = batch.column("keys")
            for i, text in _texts(batch.column("text"), width, run_tokens):
                if keys[i] != meeting:
                    if rows:
                        yield links(meeting, *zip(*rows))
                    meeting, rows = keys[i], []
                opened = seeds_of[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                rows.append((ids[i], sides[i], spans[i], opened, text))
        if rows:
            yield links(meeting, *zip(*rows))

    return run, _LINK


def _compare_blocks(large: DataFrame, texts: DataFrame, named: DataFrame, width: int, least: int, percent: int) -> DataFrame:
    """Links between the texts of the large seeds (`large`: key, leader, doc_id).

    The seeds of one leader are looked at together: a repeated passage has several of them, and nearly the same texts.
    """
    placed = large.groupBy("leader", "doc_id").agg(F.collect_set("key").alias("keys")).join(
        texts.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id")
    need = placed.groupBy("leader").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS),
                                                   F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = placed.drop("bytes").join(need, "leader").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least("block", x).alias("low"), F.greatest("block", x).alias("high")))
    spans = named.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "node")).alias("spans"))
    rows = texts.join(placed, "doc_id").join(spans, "doc_id", "left") \
        .select("doc_id", "text", "keys", "spans", "leader", "block", F.explode(meets).alias("meeting")) \
        .select("doc_id", "text", "keys", "spans", "leader", "block", "meeting.*")
    run, schema = _block_links(width, least, percent)
    key = ["leader", "low", "high"]
    return rows.repartition(*key).sortWithinPartitions(*key, "doc_id").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH,
                      percent: int = PERCENT, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, start_word, end_word (words from 0, end exclusive), class_id, n_links: a row per repeated passage.

    Words are runs of non-white characters with A-Z lower-cased. Passages have at least `shortest`
    words and a similarity of `percent` on shingles of `width` words to another document's
    passage. class_id is the smallest doc_id of the passage's class, n_links its verified links.
    Documents without such a passage, null or short texts and null ids have no row; rows that
    repeat a doc_id are one document; other columns are ignored.
    """
    least = shortest - width + 1
    run_tokens, _ = shared_run(width, least, percent)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")) \
        .where("doc_id is not null and text is not null")
    run, schema = _signed(width, run_tokens)
    signed = cut_lineage(source.mapInArrow(run, schema).where(F.col("n") >= run_tokens))
    # Of rows that repeat an id the one with the least tokens' name counts, here and among the texts.
    one = signed.groupBy("doc_id").agg(F.min("copy").alias("copy"))
    first = signed.groupBy("copy").agg(F.any_value("n").alias("n"), F.any_value("seeds").alias("seeds"))
    groups = one.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = cut_lineage(groups.join(first, "copy"))
    every = reps.select(F.explode("seeds").alias("seed"), F.col("rep").alias("doc_id")).select("seed.*", "doc_id")
    shared = every.groupBy("key").agg((F.min("doc_id") < F.max("doc_id")).alias("several"), F.min("doc_id").alias("leader")) \
        .where("several").select("key", "leader")
    met = cut_lineage(every.join(shared, "key"))
    wanted = met.select("doc_id").distinct()
    texts = _named_texts(source, wanted, reps, width, run_tokens)
    pairs = cut_lineage(met.where("doc_id <> leader").select("leader", F.col("doc_id").alias("partner")).distinct())
    links = cut_lineage(_verified(pairs, texts, width, least, percent))
    # Copies hold each other's whole text.
    twice = reps.where((F.col("copies") > 1) & (F.col("n") >= least)).select(
        F.col("rep").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("n") + width - 1).cast("long").alias("end"),
        (F.col("copies") - 1).alias("n"))
    merged = _spans(links, twice)
    classes = _components(links, merged)
    # What is left: seeds with places in several components or in none.
    named = cut_lineage(merged.join(classes, "node", "left").groupBy(F.coalesce("component", "node").alias("name"), "doc_id", "node")
                        .agg(F.min("start").alias("start"), F.max("end").alias("end")))
    inside = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("end") - width + 1)
    covered = met.join(named.select("doc_id", "start", "end", "name"), "doc_id").where(inside) \
        .select("key", "doc_id", "place", "name")
    state = met.join(covered, ["key", "doc_id", "place"], "left").withColumn("bare", F.col("name").isNull()) \
        .withColumn("name", F.coalesce("name", F.xxhash64("doc_id", "place", F.lit("bare"))))
    state = cut_lineage(state.select("key", "leader", "doc_id", "name").distinct())
    open_keys = state.groupBy("key").agg((F.min("name") < F.max("name")).alias("several"),
                                         F.count_distinct("doc_id").alias("texts")).where("several and texts > 2")
    open_rows = cut_lineage(state.join(open_keys.select("key", "texts"), "key"))
    small = open_rows.where(F.col("texts") <= ALL_PAIRS)
    other = small.select("key", F.col("doc_id").alias("first"), F.col("name").alias("first_name"))
    left = small.join(other, "key").where("first < doc_id and name <> first_name") \
        .select(F.col("first").alias("leader"), F.col("doc_id").alias("partner")).distinct() \
        .join(pairs, ["leader", "partner"], "left_anti")
    found = cut_lineage(_verified(cut_lineage(left), texts, width, least, percent))
    large = cut_lineage(open_rows.where(F.col("texts") > ALL_PAIRS).select("key", "leader", "doc_id").distinct())
    nodes = named.select("doc_id", "start", "end", F.col("name").alias("node"))
    blocked = cut_lineage(_compare_blocks(large, texts, nodes, width, least, percent))
    links = cut_lineage(links.union(found).union(blocked).distinct())
    merged = _spans(links, twice)
    rows = _rows(merged, _components(links, merged))
    copies = one.join(groups.select("copy", "rep"), "copy").select(F.col("rep").alias("doc_id"), F.col("doc_id").alias("copy_id"))
    return rows.join(copies, "doc_id").select(
        F.col("copy_id").alias("doc_id"), "start_word", "end_word", "class_id", "n_links")


def _named_texts(source: DataFrame, wanted: DataFrame, reps: DataFrame, width: int, run_tokens: int) -> DataFrame:
    """The texts of the wanted documents; of rows that repeat an id, the one that was signed."""
    chosen = source.join(wanted, "doc_id")
    again = chosen.groupBy("doc_id").count().where("count > 1").select("doc_id")
    single = chosen.join(again, "doc_id", "left_anti")
    sign, _ = _signed(width, run_tokens)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [part.column("copy") for part in sign(iter([batch]))]
            names = pa.chunked_array(made, pa.string()).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names], ["doc_id", "text", "copy"])

    several = chosen.join(again, "doc_id").select("doc_id", "text").mapInArrow(named, "doc_id long, text string, copy string") \
        .join(reps.select(F.col("rep").alias("doc_id"), "copy"), ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id"])
    return cut_lineage(single.select("doc_id", "text").union(several.select("doc_id", "text")))


def _spans(links: DataFrame, whole: DataFrame) -> DataFrame:
    """doc_id, start, end, n, node: the verified spans; those of one text that overlap have one node."""
    spans = links.select(F.col("leader").alias("doc_id"), F.col("start_a").alias("start"), F.col("end_a").alias("end"),
                         F.lit(1).cast("long").alias("n")) \
        .union(links.select("partner", "start_b", "end_b", F.lit(1).cast("long"))).union(whole) \
        .groupBy("doc_id", "start", "end").agg(F.sum("n").alias("n"))
    order = W.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))
    merged = spans.withColumn("opens", opens).withColumn("number", F.sum("opens").over(order))
    return cut_lineage(merged.select("doc_id", "start", "end", "n", F.xxhash64("doc_id", "number").alias("node")))


def _components(links: DataFrame, merged: DataFrame) -> DataFrame:
    named = merged.select("doc_id", "start", "end", "node")
    joined = links.join(named.toDF("leader", "start_a", "end_a", "one"), ["leader", "start_a", "end_a"]) \
        .join(named.toDF("partner", "start_b", "end_b", "two"), ["partner", "start_b", "end_b"]).select("one", "two")
    return connected_components(joined.distinct(), "one", "two")


def _rows(merged: DataFrame, classes: DataFrame) -> DataFrame:
    passages = merged.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start_word"),
                                          F.max("end").alias("end_word"), F.sum("n").alias("n_links"))
    passages = passages.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = passages.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return passages.join(names, "component").select("doc_id", "start_word", "end_word", "class_id", "n_links")
