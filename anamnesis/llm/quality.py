"""Quality rules on whole texts, and an isolation forest over their statistics.

The base rules count words, symbols, repeated lines and repeated runs of words. Beside these
counts a text has the statistics of `STATISTICS`. An isolation forest cuts them at random places:
a text that stands apart from usual ones is alone after few cuts, so the mean length of its paths
is short. The forest is grown from bounded samples of labelled rows that pass the base rules: paths
are measured among rows labelled good, and rows labelled bad only widen the span of the cuts. The
threshold comes from the paths of all labelled rows that pass: of the thresholds that lose at most
`most_lost` of the good rows, the one that gains most (share of bad rows caught less share of good rows lost).

Texts are read once; what follows works on a row of numbers per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.arrays import WHITE, byte_class, distinct_in_rows, mix, range_hashes, runs, text_slices
from anamnesis.operators.sizing import fits_broadcast
from anamnesis.session import cut_lineage

#: The base rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"

TREES = 128
TREE_ROWS = 256
DEPTH = 10
SAMPLE_ROWS = 16_384
BINS = 10_000

STATISTICS = ("characters a word", "symbols a word", "repeated lines", "repeated words", "capitals", "digits",
              "stops a word", "exclamations a word", "words without letters", "words a line", "share of the commonest word",
              "control characters and the like")

_SYMBOL = byte_class(*((ord(c), ord(c)) for c in SYMBOLS))
_UPPER = byte_class((65, 90))
_DIGIT = byte_class((48, 57))
_LETTER = byte_class((65, 90), (97, 122), (0x80, 0xFF))
_STOP = byte_class((44, 44), (46, 46), (58, 59), (63, 63))
_SHOUT = byte_class((33, 33))
_ODD = byte_class((0, 8), (14, 31), (64, 64), (91, 96), (123, 127), (43, 43), (61, 61))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _counts_of(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often a value stands in its row, whether it is the first such), for every place."""
    order = np.lexsort((values, row))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (values[order][1:] != values[order][:-1]) | (row[order][1:] != row[order][:-1])
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(order)))
    count, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    count[order] = np.repeat(size, size)
    first[order[start]] = True  # the sort is stable
    return count, first


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, statistics) of every text. Base counts: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words. Words and lines are told apart by 64-bit hashes."""
    rows = len(offsets) - 1
    solid = ~WHITE[data]
    start, end, row = runs(solid, offsets)
    n_words = np.bincount(row, minlength=rows)
    word_chars = _per_row(solid & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_row(_SYMBOL[data], offsets)

    line_start, line_end, line_row = runs(data != 10, offsets)
    filled = _between(solid, line_start, line_end)
    line_start, line_end, line_row = line_start[filled], line_end[filled], line_row[filled]
    _, first = _counts_of(range_hashes(data, line_start, line_end), line_row)
    n_dup_lines = np.bincount(line_row[~first], minlength=rows)
    n_lines = np.bincount(line_row, minlength=rows)

    word = range_hashes(data, start, end)
    times, _ = _counts_of(word, row)
    commonest = np.zeros(rows, np.int64)
    np.maximum.at(commonest, row, times)
    repeated = np.zeros(len(word), dtype=bool)
    if len(word) >= WINDOW:
        last = len(word) - WINDOW + 1
        window = word[:last].copy()
        for step in range(1, WINDOW):
            window = mix(window * np.uint64(0x9FB21C651E98DF25) + word[step:step + last])
        at = np.flatnonzero(row[:last] == row[WINDOW - 1:])
        seen, _ = _counts_of(window[at], row[at])
        for step in range(WINDOW):
            repeated[at[seen > 1] + step] = True
    n_repeat_words = np.bincount(row[repeated], minlength=rows)
    wordless = ~_between(_LETTER[data] | _DIGIT[data], start, end)

    words, letters = np.maximum(n_words, 1), np.maximum(_per_row(_LETTER[data], offsets), 1)
    characters = np.maximum(word_chars, 1)
    made = [word_chars / words, n_symbols / words, n_dup_lines / np.maximum(n_lines, 1), n_repeat_words / words,
            _per_row(_UPPER[data], offsets) / letters, _per_row(_DIGIT[data], offsets) / characters,
            _per_row(_STOP[data], offsets) / words, _per_row(_SHOUT[data], offsets) / words,
            np.bincount(row[wordless], minlength=rows) / words, n_words / np.maximum(n_lines, 1), commonest / words,
            _per_row(_ODD[data], offsets) / characters]
    return np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], axis=1), np.stack(made, axis=1)


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether any flag is set in each range."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[end] > total[start]


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_slices(batch.column(1)):
            base, made = text_statistics(data, offsets)
            cut = pa.array(np.arange(len(made) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), *(pa.array(base[:, i], pa.int64()) for i in range(len(BASE))),
                 pa.ListArray.from_arrays(cut, pa.array(made.ravel(), pa.float64()))], ["doc_id", *BASE, "statistics"])


def rule_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the base counts, `statistics` and base_failed of every row; a null text has no words."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", statistics array<double>"
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")) \
        .mapInArrow(_measure, schema).withColumn("base_failed", failed)


class Forest:
    """Isolation trees as arrays: a node cuts one statistic; leaves hold the length of their path.

    A cut lies anywhere between the least and the greatest value that rows of `usual` and `pool` have in the node;
    path lengths count the rows of `usual` alone. A text where none of these lies is alone at once.
    """

    def __init__(self, usual: np.ndarray, pool: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS,
                 depth: int = DEPTH, seed: int = 1):
        rng = np.random.RandomState(seed)
        self.depth, nodes = depth, 2 ** (depth + 1) - 1
        self.feature = np.zeros((trees, nodes), np.int16)
        self.cut = np.full((trees, nodes), np.inf)
        self.length = np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            drawn = usual[rng.permutation(len(usual))[:tree_rows]]
            other = pool[rng.permutation(len(pool))[:tree_rows]]
            self._grow(t, 0, drawn, other, 0, rng)
        self.unit = float(_mean_path(np.array([max(min(tree_rows, len(usual)), 2)]))[0])

    def _grow(self, tree: int, node: int, rows: np.ndarray, pool: np.ndarray, depth: int, rng: np.random.RandomState) -> None:
        both = np.concatenate([rows, pool])
        low, high = both.min(axis=0), both.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or not len(rows) or len(both) < 2 or not len(open_):
            self._leaf(tree, node, depth, depth + _mean_path(np.array([len(rows)]))[0])
            return
        feature = open_[rng.randint(len(open_))]
        cut = rng.uniform(low[feature], high[feature])
        self.feature[tree, node], self.cut[tree, node] = feature, cut
        here, there = rows[:, feature] <= cut, pool[:, feature] <= cut
        self._grow(tree, 2 * node + 1, rows[here], pool[there], depth + 1, rng)
        self._grow(tree, 2 * node + 2, rows[~here], pool[~there], depth + 1, rng)

    def _leaf(self, tree: int, node: int, depth: int, length: float) -> None:
        """A leaf above the last level sends everything to its left, down to the last level."""
        while True:
            self.length[tree, node] = length
            if depth == self.depth:
                return
            node, depth = 2 * node + 1, depth + 1

    def normality(self, statistics: np.ndarray) -> np.ndarray:
        """Mean path length over that of a random tree; small for rows that stand apart."""
        total = np.zeros(len(statistics))
        every = np.arange(len(statistics))
        for t in range(len(self.feature)):
            node = np.zeros(len(statistics), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (statistics[every, self.feature[t, node]] > self.cut[t, node])
            total += self.length[t, node]
        return total / (len(self.feature) * self.unit)


def _mean_path(size: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search in a random binary tree of so many rows."""
    size = size.astype(float)
    several = np.maximum(size, 2)
    return np.where(size < 2, 0.0, 2 * (np.log(several - 1) + 0.5772156649015329) - 2 * (several - 1) / several)


class Judge:
    """A forest and the bin of normality below which a text is refused; without a forest nothing is."""

    def __init__(self, forest: Forest | None, threshold: int):
        self.forest, self.threshold = forest, threshold


def _with_normality(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("statistics")
            made = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.normality(made), pa.float64())],
                                             names=[*batch.schema.names, "normality"])

    return run


def with_normality(measured: DataFrame, forest: Forest) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema.fields)
    return measured.mapInArrow(_with_normality(forest), schema + ", normality double")


def calibrate(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_lost: float = 0.01) -> Judge:
    """`labels`: doc_id, quality (1 good, 0 bad); of an id with both, the bad one counts.

    The forest is grown from about `sample_rows` rows of each kind at most, drawn by a hash of their
    content; the threshold comes from all labelled rows.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)") \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = cut_lineage(known)
    passing = measured.where("not base_failed")
    labelled = passing.join(F.broadcast(known) if fits_broadcast(known) else known, "doc_id")
    good, bad = labelled.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    if not good:
        return Judge(None, 0)
    forest = Forest(_sample(labelled.where("quality = 1"), good, sample_rows),
                    _sample(labelled.where("quality = 0"), bad, sample_rows))
    bins = with_normality(labelled.select("statistics", "quality"), forest) \
        .groupBy("quality", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    lowest, highest = min(r.bin for r in bins), max(r.bin for r in bins)
    by = np.zeros((2, highest - lowest + 2), np.int64)
    for r in bins:
        by[r.quality, r.bin - lowest + 1] += r.n
    lost, caught = np.cumsum(by[1]) / good, np.cumsum(by[0]) / max(bad, 1)
    allowed = np.flatnonzero(lost <= most_lost)
    return Judge(forest, int(lowest + allowed[np.argmax((caught - lost)[allowed])]))


def _bin():
    return F.floor(F.col("normality") * BINS).cast("long")


def _sample(rows: DataFrame, total: int, most: int) -> np.ndarray:
    """The statistics of all rows, or of about `most` of them; in an order of their own."""
    million = int(min(1.0, most / max(total, 1)) * 1_000_000)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "statistics"), F.lit(1_000_000)) < million).select("statistics").toArrow()
    flat = drawn.column("statistics").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    made = flat.reshape(-1, len(STATISTICS))
    return made[np.lexsort(made.T)]


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, normality:
    one row per row of `docs`.

    A null or empty text has no words and fails the base rules. A row that passes them is kept
    unless its normality lies below the threshold. Without rows labelled good there is no forest,
    and without rows labelled bad no threshold: the base rules decide alone; normality is then
    null in the first case. A null id takes no label. Repeated rows are judged alike. Other columns are ignored.
    """
    measured = cut_lineage(rule_statistics(docs, id_column, text_column))
    judge = calibrate(measured, labels)
    if judge.forest is None:
        scored = measured.withColumn("normality", F.lit(None).cast("double"))
    else:
        scored = with_normality(measured, judge.forest)
    normal = F.coalesce(_bin() >= F.lit(judge.threshold), F.lit(True))
    return scored.withColumn("kept", ~F.col("base_failed") & normal) \
        .select("doc_id", *BASE, "base_failed", "kept", "normality")
