"""Language of a text by error-correcting output codes over letter n-grams.

Every language has a codeword of bits. One binary classifier per bit tells apart the languages
whose bit is 1 from those whose bit is 0, by the n-grams of letters (1 to 3 bytes of lower-cased
letters, a blank between words) of a text. A text's bits need not match any codeword: decoding
sums over the bits the logistic loss of the classifier's margin under each codeword, weighted by how well
that bit was told apart in training, and the language of least loss wins. A near tie is flagged.

The classifiers are linear in n-gram frequencies with the log-odds of the two sides as weights.
All they need are n-gram counts by language, which are summed over all training rows by Spark in
a table of fixed size (languages x buckets); nothing else reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.arrays import LOWER_ASCII, byte_class, mix, text_slices

BUCKETS = 1 << 14
SMOOTHING = 0.5
AMBIGUOUS = 0.1
MAX_LANGUAGES = 512
_LETTER = byte_class((97, 122), (0x80, 0xFF))


def letter_grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of the n-grams of 1, 2 and 3 bytes. What is no letter is a blank; runs of blanks give none."""
    low = LOWER_ASCII[data].astype(np.uint32)
    letter = _LETTER[low.astype(np.uint8)]
    low[~letter] = 32
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for width in (1, 2, 3):
        count = len(low) - width + 1
        if count <= 0:
            return
        code = np.zeros(count, dtype=np.uint32)
        some = np.zeros(count, dtype=bool)
        for step in range(width):
            code = (code << np.uint32(8)) | low[step:step + count]
            some |= letter[step:step + count]
        keep = some & (row[:count] == row[width - 1:])
        if width == 3:  # no blank in the middle: an n-gram does not reach over a word
            keep &= letter[1:1 + count]
        code = code[keep] + np.uint32(width << 24)
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1)
        yield slot.astype(np.int64), row[:count][keep]


def _count(buckets: int):
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, code = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            for low, high, data, offsets in text_slices(batch.column(1)):
                own = code.ravel()[low:high]
                for slot, row in letter_grams(data, offsets, buckets):
                    flat = np.bincount(own[row] * buckets + slot, minlength=len(langs) * buckets)
                    for i, lang in enumerate(langs):
                        part = flat[i * buckets:(i + 1) * buckets]
                        totals[lang] = totals[lang] + part if lang in totals else part.copy()
        for lang, values in totals.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(values[at], pa.int64())], schema=schema)

    return run, "lang string, bucket int, n long"


def codewords(languages: int) -> np.ndarray:
    """A row of bits for each language: every split in two for up to 7, beyond that fixed pseudo-random bits."""
    if languages < 2:
        return np.zeros((languages, 0), dtype=np.int64)
    if languages <= 7:
        splits = [(1, *rest) for rest in product((0, 1), repeat=languages - 1) if not all(rest)]
        return np.array(splits, dtype=np.int64).T.reshape(languages, -1)
    width = 16 * int(np.ceil(np.log2(languages)))
    seeds = np.arange(languages * width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(seeds) >> np.uint64(63)).astype(np.int64).reshape(languages, width)


class Model:
    """Log-odds of every bit and bucket, with the scale and weight of each bit."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.codes = codewords(len(languages))
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)  # each language counts alike
        weights, scale, trust = [], [], []
        for bit in range(self.codes.shape[1]):
            one = self.codes[:, bit] == 1
            # The two sides are the mixtures of their languages.
            odds = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))
            means = share @ odds
            gap = means[one].min() - means[~one].max()
            middle = (means[one].min() + means[~one].max()) / 2
            weights.append(odds - middle)
            scale.append(4.0 / max(abs(gap), 1e-3))
            trust.append(max(gap, 0.01))
        self.weights = np.array(weights, dtype=np.float64).reshape(len(weights), counts.shape[1]).T.copy()
        self.scale = np.array(scale)
        self.trust = np.array(trust) / max(np.sum(trust), 1e-9)

    def decode(self, margins: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language row, score, ambiguous) for summed margins over a number of n-grams."""
        if self.codes.shape[1] == 0:  # one language only
            return np.zeros(len(grams), np.int64), np.ones(len(grams)), np.zeros(len(grams), bool)
        mean = margins / np.maximum(grams, 1)[:, None] * self.scale
        loss = np.zeros((len(grams), len(self.languages)))
        for i, code in enumerate(self.codes):
            loss[:, i] = (np.logaddexp(0, -mean * (2 * code - 1)) * self.trust).sum(axis=1)
        share = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        two = np.sort(loss, axis=1)
        return best, share[np.arange(len(best)), best], (two[:, 1] - two[:, 0]) < AMBIGUOUS


def train(rows: DataFrame, buckets: int = BUCKETS) -> Model:
    """`rows` has lang (not null) and text; all of them are counted."""
    run, schema = _count(buckets)
    sums = rows.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = [r.lang for r in rows.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((len(languages), buckets))
    found = {lang: i for i, lang in enumerate(languages)}
    for r in sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).toLocalIterator():
        cells = np.array([(c.bucket, c.n) for c in r.counts], dtype=np.int64).reshape(-1, 2)
        table[found[r.lang], cells[:, 0]] = cells[:, 1]
    return Model(languages, table)


def _predict(model: Model, buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                        ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(2)):
                rows = high - low
                margins, grams = np.zeros((rows, model.weights.shape[1])), np.zeros(rows)
                for slot, row in letter_grams(data, offsets, buckets):
                    grams += np.bincount(row, minlength=rows)
                    for bit in range(model.weights.shape[1]):
                        margins[:, bit] += np.bincount(row, weights=model.weights[:, bit][slot], minlength=rows)
                if model.languages:
                    best, score, close = model.decode(margins, grams)
                else:
                    best, score, close = np.zeros(rows, np.int64), np.zeros(rows), np.ones(rows, bool)
                # ASCII letters decide at once; other texts are looked at by their characters.
                letter = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum((LOWER_ASCII[data] >= 97) & (LOWER_ASCII[data] <= 122), out=letter[1:])
                some = letter[offsets[1:]] > letter[offsets[:-1]]
                for i in np.flatnonzero(~some).tolist():
                    some[i] = any(map(str.isalpha, data[offsets[i]:offsets[i + 1]].tobytes().decode()))
                some &= bool(model.languages)
                best = np.where(some, best, len(model.languages))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, rows), batch.column(1).slice(low, rows), pa.array(names[best], pa.string()),
                     pa.array(np.where(some, score, 0.0)), pa.array(close & some)], schema=schema)

    return run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def remainder(id_column: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts))


def identify_languages(docs: DataFrame, parts: int = 3, held_part: int = 1, id_column: str = "doc_id",
                       text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), ambiguous: one row per row of `docs`.

    Rows whose crc32(id) mod `parts` is not `held_part` and whose language is not null are learnt
    from. A null text, or one without any letter, is `und` with score 0; so is every text if
    nothing was learnt. A null id is not learnt from and not held out.
    """
    held = F.coalesce(remainder(id_column, parts) == held_part, F.lit(False))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), held.alias("held_out"),
                         F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    model = train(source.where("not held_out and doc_id is not null and lang is not null and text is not null"))
    run, schema = _predict(model, BUCKETS)
    return source.select("doc_id", "held_out", "text").mapInArrow(run, schema)
