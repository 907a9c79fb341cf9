"""Numpy kernels that run inside Arrow tasks. Spark decides which rows meet in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DISTANCE_DECIMALS = 6
#: Bits of a distance (0 to 2) in millionths.
MICRO_BITS = 21
#: More than rounding can move a similarity.
MARGIN = 10.0 ** -DISTANCE_DECIMALS
#: Pairs of rows and queries that a task looks at together.
PAIRS = 1 << 19

Groups = Iterable[tuple[np.ndarray, np.ndarray]]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """ARRAY<FLOAT> column as a row-major float64 matrix; all rows share one dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % n:
        raise ValueError("vectors of different dimensions in one table")
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, which puts them at distance one."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.where(norms == 0, 1.0, norms)[:, None]


def distances(units: np.ndarray, query_units: np.ndarray) -> np.ndarray:
    return np.round(1.0 - units @ query_units.T, DISTANCE_DECIMALS)


class BestRows:
    """The k lowest (value, memory_id, chunk_index) of each query over a stream of batches."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.best: list[list[tuple]] = [[] for _ in range(queries)]
        self.worst = np.full(queries, np.inf)

    def add(self, memory_ids: list, chunk_indexes: list, values: np.ndarray) -> None:
        """`values[i, q]` of row i for query q; infinity keeps the row from that query."""
        if not len(values) or self.k <= 0:
            return
        if len(values) > self.k:
            bound = np.partition(values, self.k - 1, axis=0)[self.k - 1]
        else:
            bound = np.full(values.shape[1], np.inf)
        # Ties at the bound stay in: the id order below decides between them.
        keep = (values <= np.minimum(bound, self.worst)[None, :]) & np.isfinite(values)
        for q in np.flatnonzero(keep.any(axis=0)):
            rows = np.flatnonzero(keep[:, q])
            merged = self.best[q] + [(values[i, q], memory_ids[i], chunk_indexes[i]) for i in rows]
            merged.sort()
            self.best[q] = merged[: self.k]
            if len(self.best[q]) == self.k:
                self.worst[q] = self.best[q][-1][0]

    def table(self, query_ids: list, sign: float = 1.0, name: str = "distance") -> pa.Table:
        rows = [(query_ids[q], m, c, sign * v) for q, hits in enumerate(self.best) for v, m, c in hits]
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        return pa.table({
            "query_id": pa.array(columns[0], pa.string()),
            "memory_id": pa.array(columns[1], pa.string()),
            "chunk_index": pa.array(columns[2], pa.int32()),
            name: pa.array(columns[3], pa.float64()),
        })


class TermScores:
    """BM25 of token lists against a fixed set of weighted queries."""

    def __init__(self, weights: list[tuple[str, str, float]], avgdl: float, k1: float, b: float):
        """`weights` holds (query_id, term, idf)."""
        self.query_ids = sorted({w[0] for w in weights})
        position = {q: i for i, q in enumerate(self.query_ids)}
        vocabulary = sorted({w[1] for w in weights})
        term_position = {t: i for i, t in enumerate(vocabulary)}
        self.vocabulary = pa.array(vocabulary, pa.string())
        self.avgdl, self.k1, self.b = avgdl, k1, b
        askers: list[list[int]] = [[] for _ in vocabulary]
        self.idf = np.zeros(len(vocabulary))
        for query_id, term, idf in weights:
            askers[term_position[term]].append(position[query_id])
            self.idf[term_position[term]] = idf
        self.degree = np.array([len(a) for a in askers], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.degree)[:-1]]) if len(askers) else np.zeros(0, np.int64)
        self.askers = np.array([q for a in askers for q in a], dtype=np.int64)

    def score(self, tokens: pa.Array) -> np.ndarray:
        """documents x queries; documents that share no term with a query stay at zero."""
        lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        documents = len(tokens)
        found = pc.index_in(tokens.flatten(), self.vocabulary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(documents), lengths)[known]
        term = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        pair, tf = np.unique(doc * max(len(self.vocabulary), 1) + term, return_counts=True)
        doc, term = np.divmod(pair, max(len(self.vocabulary), 1))
        return self._sum(doc, documents, lengths, term, tf)

    def score_postings(self, doc: np.ndarray, documents: int, lengths: np.ndarray, terms: pa.Array,
                       tf: np.ndarray) -> np.ndarray:
        """The same from postings: `doc` numbers the documents, `lengths` are theirs."""
        found = pc.index_in(terms, self.vocabulary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        doc, tf, term = doc[known], tf[known], found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((term, doc))  # sums of floats in one order, whatever the order of the rows
        return self._sum(doc[order], documents, lengths, term[order], tf[order])

    def _sum(self, doc: np.ndarray, documents: int, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        queries = len(self.query_ids)
        norm = 1 - self.b + self.b * lengths[doc] / self.avgdl
        part = self.idf[term] * (tf * (self.k1 + 1) / (tf + self.k1 * norm))
        fan = self.degree[term]
        row = np.repeat(np.arange(len(doc)), fan)
        within = np.arange(len(row)) - np.repeat(np.cumsum(fan) - fan, fan)
        query = self.askers[self.start[term[row]] + within]
        flat = np.bincount(doc[row] * queries + query, weights=part[row], minlength=documents * queries)
        return flat.reshape(documents, queries)


class PatternCounts:
    """Which memories hold all numbers of a pattern, each as often as the pattern asks for it in all."""

    def __init__(self, patterns: np.ndarray, numbers: np.ndarray):
        """A row per pattern and number it asks for."""
        order = np.argsort(numbers, kind="stable")
        self.askers = patterns[order]
        self.degree = np.bincount(numbers)
        self.start = np.cumsum(self.degree) - self.degree
        self.needed = np.bincount(patterns)

    def complete(self, memory: np.ndarray, numbers: np.ndarray, memories: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(memory, pattern) of the complete ones. `memory` is sorted; memories are taken `PAIRS` counts at a time."""
        patterns = len(self.needed)
        if not patterns:
            return
        step = max(1, PAIRS // patterns)
        for low in range(0, memories, step):
            first, stop = np.searchsorted(memory, [low, low + step])
            counts = np.zeros(min(step, memories - low) * patterns, np.int64)
            fans = np.cumsum(self.degree[numbers[first:stop]])
            cuts = [0, *np.searchsorted(fans, np.arange(4 * PAIRS, int(fans[-1]) if len(fans) else 0, 4 * PAIRS)), stop - first]
            for a, b in zip(cuts, cuts[1:]):
                number, own = numbers[first + a:first + b], memory[first + a:first + b] - low
                fan = self.degree[number]
                at = np.repeat(self.start[number] - (np.cumsum(fan) - fan), fan) + np.arange(int(fan.sum()))
                counts += np.bincount(np.repeat(own, fan) * patterns + self.askers[at], minlength=len(counts))
            found, pattern = np.nonzero(counts.reshape(-1, patterns) == self.needed)
            yield low + found, pattern


class NearestRows:
    """The k nearest rows of each query by (distance, memory_id, chunk_index), over a stream of blocks.

    Products are taken piece by piece, so no matrix grows with the queries or the rows. What a query
    already holds bounds what it still takes, and a hit is one whole number that sorts by query, distance
    in millionths and place in the order of the ids.
    """

    def __init__(self, units: np.ndarray, k: int):
        self.units, self.k = units, max(k, 0)
        self.ids, self.indexes = pa.array([], pa.string()), pa.array([], pa.int32())
        self.query = self.micro = self.row = np.zeros(0, np.int64)
        self.least = np.full(len(units), -np.inf)  # a smaller similarity cannot be among the k nearest

    def add(self, memory_ids: pa.Array, chunk_indexes: pa.Array, units: np.ndarray, groups: Groups | None = None,
            meets: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """`groups` are pairs of (places of rows, places of queries that meet them), by default all with all;
        a pair that two groups hold counts once. `meets(queries, rows)` says which near pairs count."""
        if not len(units) or not len(self.units) or not self.k:
            return
        groups = [(np.arange(len(units)), np.arange(len(self.units)))] if groups is None else groups
        held = len(self.ids)
        names = pa.table({"m": pa.concat_arrays([self.ids, memory_ids.cast(pa.string())]),
                          "c": pa.concat_arrays([self.indexes, chunk_indexes.cast(pa.int32())])})
        order = pc.sort_indices(names, sort_keys=[("m", "ascending"), ("c", "ascending")], null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        bits = max(1, len(order).bit_length())
        low = bits + MICRO_BITS
        if low + len(self.units).bit_length() > 63:
            raise ValueError("too many rows and queries for one block")
        best = np.sort((self.query << low) | (self.micro << bits) | rank[self.row])
        last = self._bound(best, low, bits)
        pending, waiting, flush = [], 0, max(len(self.units) * self.k, PAIRS)
        for rows, asked in self._pieces(groups):
            part = units[rows]
            close = self.units[asked] @ part.T
            bound = self.least[asked]
            if meets is None and len(part) > self.k and np.isneginf(bound).any():
                known = np.where(np.isnan(close), -np.inf, close)
                kth = np.partition(known, len(part) - self.k, axis=1)[:, len(part) - self.k] - MARGIN
                bound = np.maximum(bound, kth)
            hit = np.flatnonzero((close >= bound[:, None]).ravel())
            if len(hit):
                at, row = np.divmod(hit, len(part))
                value, query, row = close.ravel()[hit], asked[at], rows[row]
                key = (query << low) | (_millionths(value) << bits) | rank[held + row]
                take = (key <= last[query]) & (value > -np.inf)
                if meets is not None and take.any():
                    take[take] = meets(query[take], row[take])
                pending.append(key[take])
                waiting += len(pending[-1])
            if waiting >= flush:
                best, pending, waiting = self._merge(best, pending, low), [], 0
                last = self._bound(best, low, bits)
        best = self._merge(best, pending, low)
        self._bound(best, low, bits)
        self.query, self.micro = best >> low, (best >> bits) & ((1 << MICRO_BITS) - 1)
        used, self.row = np.unique(best & ((1 << bits) - 1), return_inverse=True)
        kept = names.take(pa.array(order[used]))
        self.ids, self.indexes = (kept[c].combine_chunks() for c in ("m", "c"))

    @staticmethod
    def _pieces(groups: Groups) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The groups cut so that no piece has more than `PAIRS` pairs."""
        for rows, asked in groups:
            rows_at_once = max(min(len(rows), PAIRS // 256), 1)
            step = max(1, PAIRS // rows_at_once)
            for top in range(0, len(rows), rows_at_once):
                for first in range(0, len(asked), step):
                    yield rows[top:top + rows_at_once], asked[first:first + step]

    def _merge(self, best: np.ndarray, pending: list, low: int) -> np.ndarray:
        keys = np.sort(np.concatenate([best, *pending]))
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        query = keys >> low
        return keys[np.arange(len(keys)) - np.searchsorted(query, query) < self.k]

    def _bound(self, best: np.ndarray, low: int, bits: int) -> np.ndarray:
        """The last key that each query would still take; also sets the least similarity that can be one."""
        query = best >> low
        full = np.flatnonzero(np.arange(len(best)) - np.searchsorted(query, query) == self.k - 1)
        last = np.full(len(self.units), np.iinfo(np.int64).max)
        last[query[full]] = best[full]
        micro = (best[full] >> bits) & ((1 << MICRO_BITS) - 1)
        self.least[query[full]] = 1 - micro / 10**DISTANCE_DECIMALS - MARGIN
        return last

    def table(self, query_ids: pa.Array) -> pa.Table:
        return pa.table({
            "query_id": query_ids.take(pa.array(self.query)).cast(pa.string()),
            "memory_id": self.ids.take(pa.array(self.row)),
            "chunk_index": self.indexes.take(pa.array(self.row)),
            "distance": pa.array(np.round(self.micro / 10**DISTANCE_DECIMALS, DISTANCE_DECIMALS), pa.float64()),
        })


def _millionths(similarity: np.ndarray) -> np.ndarray:
    """Distances in whole millionths, rounded as `distances` does."""
    apart = np.round(1.0 - similarity, DISTANCE_DECIMALS)
    return np.rint(np.where(np.isfinite(apart), np.maximum(apart, 0), 0) * 10**DISTANCE_DECIMALS).astype(np.int64)


def near_pairs(units: np.ndarray, others: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in `units`, places in `others`, distances) of the pairs below the threshold, piece by piece."""
    rows = max(min(len(others), PAIRS // 256), 1)
    step = max(1, PAIRS // rows)
    for top in range(0, len(others), rows):
        part = others[top:top + rows].T
        for first in range(0, len(units), step):
            close = units[first:first + step] @ part
            hit = np.flatnonzero((close >= 1 - threshold - MARGIN).ravel())
            if len(hit):
                apart = np.round(1.0 - close.ravel()[hit], DISTANCE_DECIMALS)
                near = apart < threshold
                at, other = np.divmod(hit[near], part.shape[1])
                yield at + first, other + top, apart[near]


class EarliestNear:
    """For each row, the earliest-ordered other row within a distance, over a stream of batches."""

    def __init__(self, ids: list, orders: np.ndarray, units: np.ndarray, threshold: float):
        self.ids, self.orders, self.units, self.threshold = ids, orders, units, threshold
        self.near_order = np.full(len(ids), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, orders: np.ndarray, units: np.ndarray, ids: object = None) -> None:
        if not len(units) or not len(self.units):
            return
        for at, other, _ in near_pairs(self.units, units, self.threshold):
            earlier = orders[other] < self.orders[at]
            np.minimum.at(self.near_order, at[earlier], orders[other[earlier]])

    def table(self) -> pa.Table:
        hit = np.flatnonzero(self.near_order < np.iinfo(np.int64).max)
        return pa.table({
            "memory_id": pa.array([self.ids[i] for i in hit], pa.string()),
            "near_order": pa.array(self.near_order[hit], pa.int64()),
        })


class NearestEarlier:
    """For each row the nearest earlier-ordered other row within a distance, ties to the lowest id."""

    def __init__(self, ids: list, orders: np.ndarray, units: np.ndarray, threshold: float):
        self.ids, self.orders, self.units, self.threshold = ids, orders, units, threshold
        self.best = np.full(len(ids), np.inf)
        self.similar: list[str | None] = [None] * len(ids)

    def add(self, orders: np.ndarray, units: np.ndarray, ids: pa.Array) -> None:
        if not len(units) or not len(self.units):
            return
        rank = None
        for at, other, apart in near_pairs(self.units, units, self.threshold):
            take = (orders[other] < self.orders[at]) & (apart <= self.best[at])
            if not take.any():
                continue
            if rank is None:
                rank = np.empty(len(units), np.int64)
                rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(units))
            at, other, apart = at[take], other[take], apart[take]
            order = np.lexsort((rank[other], apart, at))
            for i in order[np.unique(at[order], return_index=True)[1]].tolist():
                row, name = at[i], ids[int(other[i])].as_py()
                if apart[i] < self.best[row] or name < self.similar[row]:
                    self.best[row], self.similar[row] = apart[i], name

    def table(self) -> pa.Table:
        hit = np.flatnonzero(np.isfinite(self.best))
        return pa.table({
            "memory_id": pa.array([self.ids[i] for i in hit], pa.string()),
            "similar_id": pa.array([self.similar[i] for i in hit], pa.string()),
            "similarity": pa.array(np.round(1 - self.best[hit], DISTANCE_DECIMALS), pa.float64()),
        })
