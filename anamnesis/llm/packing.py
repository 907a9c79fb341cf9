"""Documents packed into training sequences of `window` tokens.

A document's ids fill whole windows of their own; its rest, shorter than a window, is packed.
The counts of rests by length are a histogram of fewer than `window` numbers, whatever the size
of the corpus. Combinations of two or three lengths that fill a window are enumerated; their
repeat counts are the non-negative least squares solution of "counts used = histogram", rounded
down and then filled up greedily where enough rests are left. The rests that remain are laid end
to end, longest first, and cut at the windows' ends, so that only the last sequence is short.

Only the histogram and the plan are on the driver. A rest finds its place by its rank among the
rests of its length. Ranks are counted within (length, salt), with more salts for more
documents, and offset by the totals of earlier salts, so a length that a third of all documents
have is many tasks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.llm.arrays import WHITE, ragged_index, range_hashes, runs, slices, text_bytes
from anamnesis.llm.tokens import MergeTable
from anamnesis.session import cut_lineage

WINDOW = 1024
ROWS_PER_SALT = 20_000
SOLVER_STEPS = 1500
_SLICE = 2 << 20
_CACHE_UNITS = 1 << 20

#: 1 letters, 2 digits, 3 marks, 4 white space; 0 for what the arrays do not cut: apostrophes, controls, other bytes.
_KIND = np.zeros(256, dtype=np.int8)
_KIND[0x21:0x7F] = 3
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[0x27] = 0
_KIND[WHITE] = 4


class IdEncoder:
    """Ids of whole texts as the library gives them, made for each distinct unit of a batch once.

    A unit is a word with the one space before it, or what else a run of ASCII white space holds:
    the vocabulary's splitter never looks past these bounds. A text with a special string, white
    space outside ASCII or a separator control is one unit as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.merges = MergeTable(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self):
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.ids, self.held = np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        start, end, row = self._units(data, offsets)
        units, first, inverse = np.unique(range_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(units) > _CACHE_UNITS:
            self._forget()
        slot = np.minimum(np.searchsorted(self.known, units), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[slot] != units) if len(self.known) else np.arange(len(units))
        if len(new):
            made, size = self._ids(data, start[first[new]], end[first[new]])
            known = np.concatenate([self.known, units[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.place = np.concatenate([self.place, len(self.ids) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, made])
            slot = np.searchsorted(self.known, units)
        slot = slot[inverse.ravel()]
        size = self.size[slot]
        counts = np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        return self.ids[ragged_index(self.place[slot], size)], counts

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units in order, number of each). Units of plain letters, digits and marks are
        cut and merged as arrays; the library is asked for the others."""
        length = end - start
        letters = data[ragged_index(start, length)]
        unit = np.repeat(np.arange(len(start)), length)
        kind = _KIND[letters]
        lead = np.flatnonzero((letters >= 0xC3) & (letters <= 0xC9))  # two-byte letters of the Latin blocks
        after = letters[np.minimum(lead + 1, max(len(letters) - 1, 0))]
        latin = ~((letters[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))) & \
            ~((letters[lead] == 0xC9) & (after > 0x8F)) & (after >= 0x80)
        kind[lead[latin]] = kind[lead[latin] + 1] = 1
        other = np.zeros(len(start), dtype=bool)
        other[unit[kind == 0]] = True
        for token in self.special:  # its text is the library's to judge
            other[unit[:-1][(letters[:-1] == token[0]) & (letters[1:] == token[1])]] = True
        keep = ~other[unit]
        letters, kind, unit = letters[keep], kind[keep], unit[keep]
        head = np.ones(len(letters), dtype=bool)
        head[1:] = (kind[1:] != kind[:-1]) | (unit[1:] != unit[:-1])
        # The space before a word belongs to its first pre-token; white space alone is one.
        joins = np.flatnonzero((letters[:-1] == 32) & (kind[1:] != 4) & (unit[1:] == unit[:-1])) + 1
        head[joins] = False
        at = np.flatnonzero(head)
        symbols, counts = self.merges.merge(letters, np.diff(np.append(at, len(letters)))) if len(at) else \
            (np.zeros(0, np.int64), np.zeros(0, np.int64))
        size = np.bincount(unit[at], weights=counts, minlength=len(start)).astype(np.int64)
        asked = np.flatnonzero(other)
        texts = [data[start[i]:end[i]].tobytes().decode() for i in asked]
        given = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []
        size[asked] = [len(x) for x in given]
        ids = np.empty(int(size.sum()), dtype=np.uint32)
        of_library = np.repeat(other, size)
        ids[~of_library] = symbols
        ids[of_library] = np.fromiter((i for x in given for i in x), np.uint32)
        return ids, size

    def _units(self, data, offsets):
        white = WHITE[data]
        start, end, row = runs(~white, offsets)
        spaced = (start > offsets[row]) & (data[np.maximum(start - 1, 0)] == 32)
        gap_start, gap_end, gap_row = runs(white, offsets)
        followed = gap_end < offsets[gap_row + 1]
        last = data[gap_end - 1] if len(gap_end) else np.zeros(0, np.uint8)
        alone = followed & (last != 32)  # a last line feed is a unit of its own, a last space belongs to the word
        head_end = gap_end - followed
        filled = head_end > gap_start
        all_start = np.concatenate([start - spaced, gap_start[filled], gap_end[alone] - 1])
        all_end = np.concatenate([end, head_end[filled], gap_end[alone]])
        all_row = np.concatenate([row, gap_row[filled], gap_row[alone]])
        whole = self._whole(data, offsets)
        if len(whole):
            keep = ~np.isin(all_row, whole)
            all_start = np.concatenate([all_start[keep], offsets[whole]])
            all_end = np.concatenate([all_end[keep], offsets[whole + 1]])
            all_row = np.concatenate([all_row[keep], whole])
        order = np.argsort(all_start, kind="stable")
        return all_start[order], all_end[order], all_row[order]

    def _whole(self, data, offsets) -> np.ndarray:
        """Rows that must be encoded as a whole."""
        places = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
        lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
        second, third = (data[np.minimum(lead + n, max(len(data) - 1, 0))].astype(int) for n in (1, 2))
        code = (data[lead].astype(int) << 16) | (second << 8) | third
        wide = ((code == 0xE19A80) | (code >= 0xE28080) & (code <= 0xE2808A) | np.isin(code, (0xE280A8, 0xE280A9, 0xE280AF))
                | (code == 0xE2819F) | (code == 0xE38080) | np.isin(code >> 8, (0xC285, 0xC2A0)))
        places.append(lead[wide])
        text = data.tobytes()
        for token in self.special:
            at = text.find(token)
            while at >= 0:
                places.append(np.array([at]))
                at = text.find(token, at + 1)
        return np.unique(np.searchsorted(offsets, np.concatenate(places), side="right") - 1)


_ENCODERS: dict[str, IdEncoder] = {}


def _tokenise(path: str, window: int, closing: int):
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())),
                        ("rest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = IdEncoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for low, high in slices(offsets, _SLICE):
                own = offsets[low:high + 1]
                ids, counts = encoder.encode(data[own[0]:own[-1]], own - own[0])
                at, crcs, rests = 0, [], []
                for count in counts.tolist():
                    doc = np.append(ids[at:at + count], np.uint32(closing)).astype("<u4")
                    at += count
                    full = len(doc) // window
                    crcs.append([zlib.crc32(doc[i * window:(i + 1) * window]) for i in range(full)])
                    rests.append(doc[full * window:].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(counts + 1), pa.array(crcs, pa.list_(pa.int64())),
                     pa.array(rests, pa.binary())], schema=schema)

    return run, "doc_id long, doc_tokens long, crcs array<long>, rest binary"


def combinations(window: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c >= 0, a, b > 0 and a + b + c = window; c = 0 is a pair."""
    a = np.arange(1, window)
    first, second = np.meshgrid(a, a, indexing="ij")
    third = window - first - second
    keep = (first >= second) & (second >= third) & (third >= 0)
    return np.stack([first[keep], second[keep], third[keep]], axis=1)


def repeat_counts(parts: np.ndarray, histogram: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient, scaled by the histogram's mean."""
    scale = max(histogram.mean(), 1e-9)
    wanted = histogram / scale
    real = parts > 0
    rows = np.bincount(parts[real], minlength=len(histogram))
    step = 1.0 / max(3.0 * rows.max(), 1.0)  # the norm of the matrix is at most row sum times column sum
    x = y = np.zeros(len(parts))
    momentum = 1.0
    weights = real.astype(float)
    flat = parts.ravel()
    for _ in range(steps):
        used = np.bincount(flat, weights=(y[:, None] * weights).ravel(), minlength=len(histogram))
        error = used - wanted
        error[0] = 0.0
        gradient = error[parts[:, 0]] + error[parts[:, 1]] + error[parts[:, 2]] * weights[:, 2]
        following = np.maximum(y - step * gradient, 0.0)
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = following + (momentum - 1) / faster * (following - x)
        x, momentum = following, faster
    return x * scale


@dataclass
class Plan:
    """Where the rests go. slots: (length, first rank, first sequence, offset), ascending."""

    window: int
    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    stream: np.ndarray
    patterned: int
    sequences: int


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """histogram[length] rests of each length from 1 to window - 1."""
    parts = combinations(window)
    solved = repeat_counts(parts, histogram.astype(float))
    left = histogram.astype(np.int64).copy()
    slots, used, sequence = [], np.zeros(window, np.int64), 0
    order = np.argsort(-solved, kind="stable")
    # Once rounded down as solved, then once filled up with whatever is left.
    for greedy in (False, True):
        for j in order.tolist():
            most = None if greedy else int(solved[j])
            if most == 0:
                break
            lengths = [int(x) for x in parts[j] if x]
            count = min(left[x] // lengths.count(x) for x in lengths)
            count = int(count if most is None else min(count, most))
            if count <= 0:
                continue
            offset = 0
            for x in lengths:
                slots.append((x, int(used[x]), sequence, offset))
                used[x] += count
                left[x] -= count
                offset += x
            sequence += count
    base, stream = 0, np.zeros(window, np.int64)
    for x in range(window - 1, 0, -1):
        stream[x] = base
        base += int(left[x]) * x
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 4)
    return Plan(window, (table[:, 0] << 48) | table[:, 1], table[:, 2], table[:, 3], used, stream, sequence,
                sequence + -(-base // window))


def _place(plan: Plan):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    window = plan.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "rest", "rank", "first_full"))
            for doc_id, tokens, crcs, rest, rank, first_full in zip(*columns):
                for i, crc in enumerate(crcs):
                    rows.append((doc_id, i * window, window, crc, tokens, plan.sequences + first_full + i, 0))
                length = len(rest) // 4
                if not length:
                    continue
                start = tokens - length
                if rank < plan.used[length]:
                    slot = int(np.searchsorted(plan.key, (length << 48) | rank, side="right")) - 1
                    first = int(plan.key[slot]) & ((1 << 48) - 1)
                    rows.append((doc_id, start, length, zlib.crc32(rest), tokens,
                                 int(plan.sequence[slot]) + rank - first, int(plan.offset[slot])))
                    continue
                at = int(plan.stream[length]) + (rank - int(plan.used[length])) * length
                done = 0
                while done < length:
                    sequence, offset = divmod(at + done, window)
                    taken = min(length - done, window - offset)
                    rows.append((doc_id, start + done, taken, zlib.crc32(rest[4 * done:4 * (done + taken)]), tokens,
                                 plan.patterned + sequence, offset))
                    done += taken
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run, ", ".join(f"{n} long" for n in names)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, closing: int = 0, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then the id `closing`; each id lies in one piece. ids_crc32 is over
    the piece's ids as little-endian unsigned 32-bit numbers. A null or empty text is the closing
    id alone; a null id stays null; repeated rows are packed each. Other columns are ignored. An
    empty table gives an empty result.
    """
    run, schema = _tokenise(vocabulary, window, closing)
    source = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    tokenised = cut_lineage(source.mapInArrow(run, schema))
    rows = tokenised.count()
    salts = max(1, -(-rows // ROWS_PER_SALT))
    length = (F.octet_length("rest") / 4).cast("int")
    salted = tokenised.withColumn("rest_length", length) \
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_tokens", "rest"), F.lit(salts)).cast("int"))
    groups = cut_lineage(salted.groupBy("rest_length", "salt").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("crcs").cast("long")).alias("full")))
    by_length = groups.groupBy("rest_length").agg(F.sum("n").alias("n"), F.sum("full").alias("full")) \
        .orderBy("rest_length").collect()  # at most one row per length below the window
    histogram = np.zeros(window, dtype=np.int64)
    before, total = {}, 0
    for row in by_length:
        if row.rest_length:
            histogram[row.rest_length] = row.n
        before[row.rest_length] = total
        total += row.full
    earlier = W.partitionBy("rest_length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("rest_length")) \
        if before else F.lit(0)
    offsets = groups.select("rest_length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_base"),
                            (base + F.coalesce(F.sum("full").over(earlier), F.lit(0))).alias("full_base"))
    own = W.partitionBy("rest_length", "salt").orderBy("doc_id", "doc_tokens", "rest")
    fulls = F.size("crcs").cast("long")
    ranked = salted.withColumn("place", F.row_number().over(own) - 1) \
        .withColumn("fulls", F.sum(fulls).over(own.rowsBetween(W.unboundedPreceding, 0)) - fulls)
    placed = ranked.join(offsets, ["rest_length", "salt"]).select(
        "doc_id", "doc_tokens", "crcs", "rest", (F.col("rank_base") + F.col("place")).cast("long").alias("rank"),
        (F.col("full_base") + F.col("fulls")).cast("long").alias("first_full"))
    run, schema = _place(make_plan(histogram, window))
    return placed.mapInArrow(run, schema)
