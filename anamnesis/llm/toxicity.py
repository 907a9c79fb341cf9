"""Toxicity scores from a counterfactual-regularised linear classifier over word features.

Features of a text are its distinct words and word beginnings (3 to 6 letters), hashed to a fixed
number of buckets. All labelled rows are counted per feature; the features whose counts differ
most between the classes (by log-likelihood ratio, at least `LEAST_GAIN`) are kept. A logistic model over their presence
is then fitted on a bounded sample of labelled rows.

Counterfactual part. Words that name a group of people (`identity_terms`) carry no blame. In each
labelled text that holds such a word, every other term of its list is put in its place, and the
squared change of the score is penalised. Terms of one list are thus pulled to one weight, so that a mention alone
tells the classes apart by no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anamnesis.llm.arrays import byte_class, mix, range_hashes, runs, text_slices
from anamnesis.llm.langid import remainder
from anamnesis.operators.sizing import fits_broadcast
from anamnesis.session import cut_lineage

FEATURE_BITS = 22
KEPT_FEATURES = 4096
LEAST_GAIN = 10.0
SAMPLE_ROWS = 40_000
FIT_STEPS = 1000
RIDGE = 1e-4
SWAP_PENALTY = 1.0
BEGINNINGS = (3, 4, 5, 6)
_WORD = byte_class((48, 57), (65, 90), (97, 122), (0x80, 0xFF))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Words for groups of people, by kind. A parameter; the lists are examples in four languages.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "old", "young"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)


def row_features(data: np.ndarray, offsets: np.ndarray, bits: int = FEATURE_BITS, wanted: np.ndarray | None = None):
    """(feature, row), distinct in each row, of words and their beginnings. `wanted` flags the
    features to be told; others are left out before anything is sorted."""
    data = _FOLD[data]
    start, end, row = runs(_WORD[data], offsets)
    made, rows = [_slots(range_hashes(data, start, end), bits)], [row]
    for width in BEGINNINGS:
        long = end - start >= width
        # A beginning ends between characters: continuation bytes are taken along.
        stop = start[long] + width
        stop = _whole_character(data, stop, end[long])
        value = range_hashes(data, start[long], stop)
        made.append(_slots(mix(value + np.uint64(width)), bits))
        rows.append(row[long])
    feature, row = np.concatenate(made), np.concatenate(rows).astype(np.int64)
    if wanted is not None:
        told = wanted[feature]
        feature, row = feature[told], row[told]
    key = np.unique((row << np.int64(32)) | feature)
    return key & np.int64(0xFFFFFFFF), key >> np.int64(32)


def _whole_character(data, stop, end):
    for _ in range(3):
        inside = stop < end
        stop = stop + (inside & ((data[np.minimum(stop, len(data) - 1)] & 0xC0) == 0x80))
    return np.minimum(stop, end)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class that hold a feature, summed per task."""
    totals = np.zeros((2, 1 << FEATURE_BITS), dtype=np.int32)
    seen = np.zeros(2, dtype=np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        seen += np.bincount(toxic, minlength=2)
        for low, high, data, offsets in text_slices(batch.column(0)):
            feature, row = row_features(data, offsets)
            own = toxic[low:high][row]
            for kind in (0, 1):
                slot, n = np.unique(feature[own == kind], return_counts=True)
                totals[kind, slot] += n.astype(np.int32)
    at = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(totals[0, at], seen[0]), pa.int64()),
         pa.array(np.append(totals[1, at], seen[1]), pa.int64())], ["feature", "clean", "toxic"])


def _project(kept: np.ndarray, terms: tuple[tuple[str, ...], ...]):
    """The kept features of each text, and of its counterfactuals."""
    schema = pa.schema([("toxic", pa.int32()), ("own", pa.list_(pa.int32())),
                        ("swapped", pa.list_(pa.list_(pa.int32())))])
    term_of = {term: (group, term) for group in terms for term in group}

    def chosen(data, offsets, rows):
        feature, row = row_features(data, offsets)
        slot = np.minimum(np.searchsorted(kept, feature), max(len(kept) - 1, 0))
        found = kept[slot] == feature if len(kept) else np.zeros(len(feature), bool)
        slot, row = slot[found], row[found]
        cut = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
        return [slot[cut[i]:cut[i + 1]].tolist() for i in range(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [np.frombuffer(term.encode(), np.uint8) for term in term_of]
        cut = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        marks = range_hashes(np.concatenate(raw), cut[:-1], cut[1:]) if raw else np.zeros(0, np.uint64)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(0)):
                own = chosen(data, offsets, high - low)
                swapped: list[list[list[int]]] = [[] for _ in own]
                folded = _FOLD[data].tobytes()
                # Terms are words as `row_features` cuts them, and are replaced where they stand.
                start, end, row = runs(_WORD[_FOLD[data]], offsets)
                held = np.flatnonzero(np.isin(range_hashes(_FOLD[data], start, end), marks))
                for i in np.unique(row[held]).tolist():
                    found = [(int(start[w]), int(end[w]), term_of[term][0]) for w in held[row[held] == i].tolist()
                             if (term := folded[start[w]:end[w]].decode(errors="replace")) in term_of]
                    for group in {id(g): g for _, _, g in found}.values():
                        for other in group:
                            pieces, at = [], int(offsets[i])
                            for a, b, own_group in found:
                                if own_group is group:
                                    pieces += [folded[at:a], other.encode()]
                                    at = b
                            raw = np.frombuffer(b"".join([*pieces, folded[at:offsets[i + 1]]]), np.uint8)
                            swapped[i] += chosen(raw, np.array([0, len(raw)]), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(low, high - low).cast(pa.int32()),
                     pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32())))], schema=schema)

    return run, "toxic int, own array<int>, swapped array<array<int>>"


class Model:
    """Weights of the kept features (ascending) and a constant."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, constant: float):
        self.kept, self.weights, self.constant = kept, weights, constant
        self.flags: np.ndarray | None = None

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        margin = np.full(rows, self.constant)
        if len(self.kept):
            if self.flags is None:  # made where it is used: it is larger than the model
                self.flags = np.zeros(1 << FEATURE_BITS, dtype=bool)
                self.flags[self.kept] = True
            feature, row = row_features(data, offsets, wanted=self.flags)
            margin += np.bincount(row, weights=self.weights[np.searchsorted(self.kept, feature)], minlength=rows)
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def fit(column: np.ndarray, size: np.ndarray, swapped: list[tuple[list[int], list[list[int]]]], toxic: np.ndarray,
        features: int, ridge: float = RIDGE, swap_penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on logistic loss + ridge + squared change under swaps.

    `column` holds the features of all rows one after another, `size` how many each row has.
    """
    row = np.repeat(np.arange(len(size)), size)
    # A swap's change of margin is linear: +1 for what it brings, -1 for what it removes.
    change_row, change_column, change_sign, pairs = [], [], [], 0
    for before, variants in swapped:
        for after in variants:
            for sign, values in ((1.0, set(after) - set(before)), (-1.0, set(before) - set(after))):
                change_row += [pairs] * len(values)
                change_column += list(values)
                change_sign += [sign] * len(values)
            pairs += 1
    change_row, change_column = np.array(change_row, np.int64), np.array(change_column, np.int64)
    change_sign = np.array(change_sign, np.float64)
    n = max(len(size), 1)
    rate = toxic.mean() if len(toxic) else 0.0
    constant = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    weights = np.zeros(features)
    # Row sums and column sums bound the curvature of each feature.
    load = np.bincount(column, weights=size[row], minlength=features) / (4 * n) + ridge
    if pairs:
        weight = np.bincount(change_row, minlength=pairs)
        load += 2 * swap_penalty * np.bincount(change_column, weights=weight[change_row], minlength=features) / n
    rate_of = 1.0 / load
    ahead, momentum = weights.copy(), 1.0
    for _ in range(FIT_STEPS):
        margin = constant + np.bincount(row, weights=ahead[column], minlength=len(size))
        error = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - toxic
        gradient = np.bincount(column, weights=error[row], minlength=features) / n + ridge * ahead
        if pairs:
            change = np.bincount(change_row, weights=change_sign * ahead[change_column], minlength=pairs)
            gradient += 2 * swap_penalty * np.bincount(change_column, weights=change_sign * change[change_row],
                                                       minlength=features) / n
        following = ahead - rate_of * gradient
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = following + (momentum - 1) / faster * (following - weights)
        weights, momentum = following, faster
        constant -= float(error.mean()) * 1.0
    return weights, constant


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, kept_features: int = KEPT_FEATURES,
          identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    """`labelled` has doc_id, text and toxic (0 or 1). Counts cover every row; the fit at most `sample_rows`."""
    counts = labelled.select("text", "toxic").mapInArrow(_count, "feature long, clean long, toxic long") \
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = counts.where("feature = -1").first()
    if seen is None or not seen.toxic or not seen.clean:
        rate = 0.5 if seen is None else float(bool(seen.toxic))
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0 if rate == 0.5 else (4.0 if rate else -4.0))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    base = float(seen.toxic) / (seen.toxic + seen.clean)
    both = a + b
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    ratio = part(a, both * base) + part(b, both * (1 - base))
    kept = counts.where("feature >= 0").withColumn("gain", ratio).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "feature") \
        .limit(kept_features).select("feature").toPandas()["feature"].to_numpy(np.int64)
    terms = [t.encode() for group in identity_terms for t in group]
    if terms:
        raw = np.frombuffer(b" ".join(terms), np.uint8)
        kept = np.concatenate([kept, row_features(raw, np.array([0, len(raw)]))[0]])
    kept = np.unique(kept)
    # The sample: the smallest hashes of the ids, so that a re-run task takes the same rows.
    total = int(seen.toxic + seen.clean)
    share = min(1.0, sample_rows / max(total, 1))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000)
    run, schema = _project(kept, identity_terms)
    rows = labelled.where(draw).select("text", "toxic").mapInArrow(run, schema).toArrow()
    own, variants = rows.column("own").combine_chunks(), rows.column("swapped").combine_chunks()
    flat, cut = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64), own.value_lengths().to_numpy()
    holders = np.flatnonzero(variants.value_lengths().to_numpy())
    swapped = [(own[i].as_py(), variants[i].as_py()) for i in holders.tolist()]
    weights, constant = fit(flat, cut.astype(np.int64), swapped, rows.column("toxic").to_numpy().astype(float), len(kept))
    return Model(kept, weights, constant)


def _score(model: Model, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                        ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(2)):
                score = model.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(score),
                     pa.array((score >= threshold).astype(np.int32))], schema=schema)

    return run, "doc_id long, held_out boolean, score double, predicted int"


def score_rows(rows: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The same rows and columns with `_toxicity`, the score of each text."""
    at = rows.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(data, offsets) for _, _, data, offsets in text_slices(batch.column(at))]
            made = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "_toxicity"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_toxicity", T.DoubleType())]))


def learnable(docs: DataFrame, labels: DataFrame, parts: int = 1, held_part: int = -1) -> DataFrame:
    """Labelled texts outside the held-out part: doc_id, text, toxic. A document with both labels is toxic."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(remainder("doc_id", parts) != held_part)
    known = cut_lineage(known)
    if fits_broadcast(known):
        return docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")
    return cut_lineage(docs.join(known, "doc_id").select("doc_id", "text", "toxic"))  # the texts move once


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, held_part: int = 2, threshold: float = 0.3,
             id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= threshold): one row per row of `docs`.

    Labels are learnt only from ids whose crc32 mod `parts` is not `held_part`. A null or empty
    text has the score of a text without features. A null id is scored and not held out. Rows
    without a label, with a null label or other than 0 and 1 are not learnt from. Without both
    classes the score is constant. Other columns are never read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    model = train(learnable(source, labels, parts, held_part))
    held = F.coalesce(remainder("doc_id", parts) == held_part, F.lit(False))
    run, schema = _score(model, threshold)
    return source.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, schema)
