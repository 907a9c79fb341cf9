"""Spelling variants: words within one edit of each other, found through PartEnum signatures.

One inserted, deleted or replaced letter changes the multiset of a word's letters by at most two
elements. As a binary vector over (letter, how often it came before), two such words have a
Hamming distance of at most two. The dimensions are dealt into `PARTS` parts so that the words' letters
are spread evenly; two differences touch at most two parts, so the vectors agree on all others. A
signature is made for every choice of two parts: the vector on the remaining ones. Words within
two share at least one signature exactly; equal signatures are joined and verified.

Words of one language share letters, so a signature alone would make large groups. One edit also
leaves the first or the last half of the shorter word whole. Each signature therefore carries the length of the shorter
word and one of its halves, which loses no pair and keeps groups small. A pair is checked inside the join, so only near
pairs leave it, and a large group is split as any skewed join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.arrays import LOWER_ASCII, byte_class, mix, range_hashes, runs, text_slices
from anamnesis.operators.sizing import attach
from anamnesis.session import cut_lineage

PARTS = 4
SHORTEST = 5
LEAST_COUNT = 3
MISSPELT = 97
OFTEN = 7  # occurrences of a letter beyond this many are one dimension each by hash, like the others
BATCH_WORDS = 8192
LONG_RUN = 64

#: Letters of `[A-Za-zÀ-ÿ]` in UTF-8: the latter are a lead byte C3 and one more.
_LETTER = byte_class((65, 90), (97, 122))
_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32_of_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, continued from the crc32 `before` of what precedes it."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    state = ~before[order].astype(np.uint32)
    for step in range(int(min(size[0], LONG_RUN)) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, side="left"))
        state[:live] = _CRC[(state[:live] ^ data[at[:live] + step]) & 0xFF] ^ (state[:live] >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(length > LONG_RUN).tolist():
        out[i] = zlib.crc32(data[start[i] + LONG_RUN:end[i]].tobytes(), int(out[i]))
    return out


def _slice_words(data: np.ndarray, offsets: np.ndarray, ids: list, shortest: int, misspelt: int) -> tuple[list[str], np.ndarray]:
    """(words, counts) of one slice of texts, after the deletion."""
    data = LOWER_ASCII[data]
    second = np.zeros(len(data), dtype=bool)
    second[1:] = data[:-1] == _LEAD
    start, end, row = runs(_LETTER[data] | second | (data == _LEAD), offsets)
    leads = np.concatenate(([0], np.cumsum(data == _LEAD)))
    points = (end - start) - (leads[end] - leads[start])
    long = points >= shortest
    start, end, row, points = start[long], end[long], row[long], points[long]
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    check = crc32_of_ranges(data, start, end, prefix[row])
    hit = check % np.uint32(misspelt) == 0
    changed: Counter = Counter()
    for a, b, h in zip(start[hit].tolist(), end[hit].tolist(), check[hit].tolist()):
        word = data[a:b].tobytes().decode()
        at = h % len(word)
        word = word[:at] + word[at + 1:]
        if len(word) >= shortest:
            changed[word] += 1
    start, end = start[~hit], end[~hit]
    _, first, count = np.unique(range_hashes(data, start, end), return_index=True, return_counts=True)
    words = [data[a:b].tobytes().decode() for a, b in zip(start[first].tolist(), end[first].tolist())]
    return words + list(changed), np.concatenate([count, np.array(list(changed.values()), np.int64)])


def _count_words(shortest: int, misspelt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1), most=8 << 20):
                words, count = _slice_words(data, offsets, batch.column(0).slice(low, high - low).to_pylist(),
                                            shortest, misspelt)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(count, pa.int64())], ["word", "n"])

    return run


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT, misspelt: int = MISSPELT,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: the lower-cased runs of letters of all texts, some with one letter left out."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")) \
        .where("text is not null").mapInArrow(_count_words(shortest, misspelt), "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _elements(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, letter, how many equal letters the word has before it), a row per letter of a word."""
    size = np.array([len(w) for w in words], np.int64)
    letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((letter, row))
    letter, row = letter[order], row[order]
    head = np.ones(len(row), dtype=bool)
    head[1:] = (letter[1:] != letter[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    before = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row, letter, before


def _element_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, letter, before = _elements(batch.column(0).to_pylist())
        key, count = np.unique((letter << 3) | np.minimum(before, OFTEN), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(count, pa.int64())], ["element", "n"])


def deal_parts(counts: list[tuple[int, int]], words: int, parts: int) -> dict[int, int]:
    """A part for every element, so that the parts tell words apart about equally well."""
    load, part = [0] * parts, {}
    for element, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        part[element] = load.index(min(load))
        load[part[element]] += max(min(n, words - n), 0)
    return part


def signatures(words: list[str], part_of: dict[int, int], parts: int, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, word number) of every signature of every word, as the shorter word of a pair, and as
    the longer one too where `longer` is set."""
    row, letter, before = _elements(words)
    element = (letter << 3) | np.minimum(before, OFTEN)
    known, slot = np.unique(element, return_inverse=True)
    part = np.array([part_of.get(int(e), 0) for e in known], np.int64)[slot]
    value = mix(((letter << 32) | before).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    vector = np.zeros((len(words), parts), np.uint64)  # a sum of hashes per part stands for the elements there
    np.add.at(vector, (row, part), value)
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    start = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    points = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point begins
    first = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    points = np.append(points, len(data))
    size = np.diff(first)
    keys, numbers = [], []
    for shorter in ((0, 1) if longer else (0,)):
        length = size - shorter
        half = length // 2
        halves = (range_hashes(data, start[:-1], points[first[:-1] + half]),
                  range_hashes(data, points[first[:-1] + size - (length - half)], start[1:]))
        for side, text in enumerate(halves):
            lead = mix(text + (length * 2 + side).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            for choice, gone in enumerate(combinations(range(parts), 2)):
                key = lead + np.uint64(choice)
                for p in range(parts):
                    if p not in gone:
                        key = mix(key * np.uint64(0x9FB21C651E98DF25) + vector[:, p])
                keys.append(key)
                numbers.append(np.arange(len(words)))
    return np.concatenate(keys), np.concatenate(numbers)


def _signed(part_of: dict[int, int], parts: int, longer: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_WORDS):
                piece = batch.slice(low, BATCH_WORDS)
                key, number = signatures(piece.column(0).to_pylist(), part_of, parts, longer)
                at = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), piece.column(0).take(at), piece.column(1).take(at)], ["key", "word", "n"])

    return run


def _once(first: Column, second: Column) -> Column:
    """A pair as (shorter, longer); of equal lengths as (smaller, greater)."""
    return (F.length(first) < F.length(second)) | ((F.length(first) == F.length(second)) & (first < second))


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, other, other_n): every pair of distinct words within one edit, in both directions.

    `words` has distinct `word` and `n`, and is read several times: a written table.
    """
    counts = words.select("word").mapInArrow(_element_counts, "element long, n long").groupBy("element") \
        .agg(F.sum("n").alias("n")).collect()  # a row per letter and place: bounded by the alphabet
    part_of = deal_parts([(r.element, r.n) for r in counts], words.count(), parts)
    schema = "key long, word string, n long"
    a = words.mapInArrow(_signed(part_of, parts, False), schema).alias("a")
    b = words.mapInArrow(_signed(part_of, parts, True), schema).alias("b")
    near = (F.col("a.key") == F.col("b.key")) & _once(F.col("a.word"), F.col("b.word")) \
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    # Spark takes a side to be as small as the words it is made of, and would send 24 rows per word through the driver.
    pairs = a.hint("merge").join(b, near).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"),
                                                 F.col("b.n").alias("other_n"))
    pairs = cut_lineage(pairs.dropDuplicates(["word", "other"]))
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, each round twice as far. No circles."""
    far = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = far.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = cut_lineage(attach(far, onward, "root", how="left"))
        if not step.where("onward is not null").limit(1).count():
            return far
        far = step.select("word", F.coalesce("onward", "root").alias("root"))


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT, misspelt: int = MISSPELT,
                      parts: int = PARTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of at least `shortest` letters that stands at least
    `least` times in all texts.

    A word's form is its near word (one edit) of largest n, ties to the smallest, if that n is at
    least twice its own; root is the last of the chain of forms. Null and empty texts have no
    words; in texts with a null id the deletion is drawn as for an empty id. Repeated rows count
    each time. No words give an empty result. Other columns are ignored.
    """
    words = cut_lineage(count_words(docs, shortest, least, misspelt, id_column, text_column))
    best = near_words(words, parts).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = (-F.col("best.less")) >= 2 * F.col("n")
    best = cut_lineage(best.select("word", "n_near", F.when(found, F.col("best.other")).alias("form"),
                                   F.when(found, -F.col("best.less")).alias("form_n")))
    ends = roots(best.where("form is not null"))
    # Files of short words are a small part of the rows in memory: nothing is broadcast by their size.
    return words.join(best.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
