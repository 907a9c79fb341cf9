"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, components.

A document's set holds its distinct shingles of `width` words; a shorter text is one shingle.
Documents are linked if 100 * |A and B| >= `percent` * |A or B|.

Signature. Each shingle seeds one random permutation of the signature's places and visits them
in turn; the visit at step j brings a value in [j, j + 1), and a place keeps its smallest value.
The steps are taken for all shingles of a slice of texts at once. A text is finished at the
first step that no place can gain from, so a long text takes one or two steps, and a short one
has few shingles. Places of one text are won without replacement, which lowers the variance.

Search. Texts with the same set are one class, represented by their smallest id, before anything
is compared. Classes that agree in a whole band meet in a bucket. A bucket's pairs are not
listed: first its smallest member leads and every other member is compared with it. A bucket that
is then one component, as with true copies, is done. Of those that still hold several, small
ones are compared in full. Large ones hold edited copies that agree in many bands and are partly
no near duplicates of each other; those that share members form a cluster, whose members are
dealt into blocks of bounded size. Blocks are compared pairwise as matrix products, except two
blocks of the cluster's main component, and give a spanning forest of their links at most.

Verification. Pairs are grouped by leader, split by the measured number of partners. A task
streams the texts of one leader's block and keeps one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.arrays import (LOWER_ASCII, WHITE, distinct_in_rows, mix, range_hashes, runs, shingle_hashes,
                                  text_slices)
from anamnesis.llm.components import connected_components, forest
from anamnesis.session import cut_lineage

BANDS = 42
ROWS = 6
ALL_PAIRS = 32
PARTNERS_PER_BLOCK = 256
BLOCK_TEXTS = 128
BLOCK_SHINGLES = 1 << 18
MATRIX_COLUMNS = 4096
_SIGNATURE_SLICE = 1 << 20


def shingle_sets(column: pa.Array, width: int, most: int = _SIGNATURE_SLICE):
    """(first row, end row, shingles, row of each, offsets): distinct hashed shingles of each text."""
    for low, high, data, offsets in text_slices(column, most):
        data = LOWER_ASCII[data]
        start, end, row = runs(~WHITE[data], offsets)
        hashes, row = shingle_hashes(range_hashes(data, start, end), row, high - low, width)
        values, row, own = distinct_in_rows(hashes, row, high - low)
        yield low, high, values, row, own


def superminhash(values: np.ndarray, row: np.ndarray, rows: int, places: int) -> np.ndarray:
    """A (rows, places) matrix of smallest values: the step in the upper 16 bits, a random number below."""
    best = np.full(rows * places, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not len(values):
        return best.reshape(rows, places)
    order = None  # the permutation of each active shingle, as far as it has been drawn
    for step in range(places):
        draw = mix(values + np.uint64((step + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        target = step + (draw % np.uint64(places - step)).astype(np.int64)
        if order is None:
            place, first = target, target
        else:
            here = np.arange(len(values))
            place = order[here, target].astype(np.int64)
            order[here, target] = order[here, step]
            order[here, step] = place
        value = (np.uint64(step) << np.uint64(48)) | (mix(draw) >> np.uint64(16))
        np.minimum.at(best, row * places + place, value)
        # A text is finished when its largest value lies below the next step.
        open_rows = best.reshape(rows, places).max(axis=1) >= np.uint64(step + 1) << np.uint64(48)
        keep = open_rows[row]
        if not keep.any():
            break
        values, row = values[keep], row[keep]
        if order is None:
            kind = np.uint8 if places <= 256 else np.int32
            order = np.broadcast_to(np.arange(places, dtype=kind), (len(values), places)).copy()
            here, first = np.arange(len(values)), first[keep]
            order[here, 0], order[here, first] = order[here, first], order[here, 0].copy()
        elif not keep.all():
            order = order[keep]
    return best.reshape(rows, places)


def _sign(width: int, bands: int, rows_per_band: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.string()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high, values, row, own in shingle_sets(texts, width):
                count = high - low
                signature = superminhash(values, row, count, bands * rows_per_band)
                keys = np.zeros((count, bands), dtype=np.uint64)
                for place in range(rows_per_band):
                    keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + signature[:, place * bands:(place + 1) * bands])
                keys = mix(keys + np.arange(bands, dtype=np.uint64))
                size = np.diff(own)
                set_key = _set_key(size, *_set_sums(values, row, count))
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, count), pa.array(size.astype(np.int64)), pa.array(set_key, pa.string()), lists],
                    schema=schema)

    return run, "doc_id long, n_shingles long, set_key string, bands array<long>"


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    common = len(np.intersect1d(one, two, assume_unique=True))
    return bool(common) and 100 * common >= percent * (len(one) + len(two) - common)


def _set_key(size: np.ndarray, total: np.ndarray, other: np.ndarray) -> list[str | None]:
    return [f"{n:x}.{a:016x}{b:016x}" if n else None for n, a, b in zip(size.tolist(), total.tolist(), other.tolist())]


def _set_sums(values: np.ndarray, row: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free sums that, with its size, name a text's set."""
    total, other = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    np.add.at(total, row, values)
    np.add.at(other, row, mix(values + np.uint64(0x2545F4914F6CDD1D)))
    return total, other


def _verify(width: int, percent: int):
    """Rows come sorted by (leader, block, kind): the leader's text, then its partners' texts."""
    schema = pa.schema([("first", pa.int64()), ("second", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, leader_sets, leading = None, [], False
        for batch in batches:
            heads = batch.column("leader").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            linked = []
            for low, high, values, _, own in shingle_sets(batch.column("text"), width):
                for i in range(low, high):
                    own_set = values[own[i - low]:own[i - low + 1]]
                    if kinds[i] == 0:  # an id may have several texts
                        leader_sets = leader_sets if leading and leader == heads[i] else []
                        leader_sets.append(own_set.copy())
                        leader, leading = heads[i], True
                        continue
                    leading = False
                    if leader is None or leader != heads[i]:
                        raise ValueError("a partner came before its leader")
                    if any(_similar(own_set, leader_set, percent) for leader_set in leader_sets):
                        linked.append((leader, ids[i]))
            first, second = (np.array(x, dtype=np.int64) for x in (zip(*linked) if linked else ((), ())))
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second)], schema=schema)

    return run, "first long, second long"


def verified_links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (leader, partner) whose full sets are similar enough."""
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("partners"))
    blocks = F.ceil(F.col("partners") / PARTNERS_PER_BLOCK)
    members = pairs.join(sizes, "leader").select(
        F.col("partner").alias("doc_id"), "leader", F.pmod(F.xxhash64("partner"), blocks).cast("int").alias("block"),
        F.lit(1).alias("kind"))
    heads = sizes.select(F.col("leader").alias("doc_id"), "leader",
                         F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"),
                         F.lit(0).alias("kind"))
    run, schema = _verify(width, percent)
    rows = texts.join(members.union(heads), "doc_id").select("doc_id", "text", "leader", "block", "kind")
    return rows.repartition("leader", "block").sortWithinPartitions("leader", "block", "kind") \
        .mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5,
                    percent: int = 80, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (doc_id = component_id).

    One row per row of `docs`. A null or wordless text has an empty set and is linked with nothing.
    A null id gives a null component and kept = false. Rows that repeat an id are one document with
    several texts, which is linked where any of them is; a row of it without words is linked with
    nothing. Other columns are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    run, schema = _sign(width, bands, rows_per_band)
    signed = cut_lineage(source.mapInArrow(run, schema))
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    banded = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = cut_lineage(banded.join(shared.drop("members"), "bucket").select(
        "bucket", "node", "n"))
    texts = _class_texts(source, classes, buckets.select(F.col("node").alias("doc_id")).distinct(), width)
    # First round: every member of a bucket and its smallest member.
    close = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    least = buckets.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("least"))
    pairs = buckets.join(least, "bucket").select(
        F.col("least.node").alias("leader"), F.col("least.n").alias("leader_n"), F.col("node").alias("partner"), "n") \
        .where("leader <> partner").where(close).select("leader", "partner").distinct()
    links = cut_lineage(verified_links(cut_lineage(pairs), texts, width, percent))
    components = connected_components(links, "first", "second")
    # Second round: what is left between different components of a bucket.
    named = buckets.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    state = named.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("several"),
                                        F.count(F.lit(1)).alias("members")).where("several").drop("several")
    unsettled = cut_lineage(named.join(state, "bucket"))
    small = unsettled.where(F.col("members") <= ALL_PAIRS)
    leader = small.select("bucket", F.col("node").alias("leader"), F.col("n").alias("leader_n"),
                          F.col("component").alias("leader_component"))
    pairs = small.join(leader, "bucket").where((F.col("leader") < F.col("node")) & close
                                               & (F.col("component") != F.col("leader_component")))
    pairs = cut_lineage(pairs.select("leader", F.col("node").alias("partner")).distinct())
    found = cut_lineage(verified_links(pairs, texts, width, percent))
    large = unsettled.where(F.col("members") > ALL_PAIRS)
    blocked = cut_lineage(_compare_blocks(large, texts, width, percent))
    links = links.union(found).union(blocked).union(_same_ids(signed, classes))
    components = connected_components(links, "first", "second")
    named = classes.select("set_key", "node").join(components, "node", "left") \
        .select("set_key", F.coalesce("component", "node").alias("component_id"))
    placed = signed.join(named, "set_key", "left") \
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _class_texts(source: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, text): a text of every class that the wanted ids represent. Where rows repeat an id,
    each is named by its set again, so that the choice does not follow the order of rows."""
    chosen = source.join(wanted, "doc_id")
    again = cut_lineage(chosen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    single = chosen.join(again, "doc_id", "left_anti")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, row, own in shingle_sets(batch.column(1), width):
                keys = _set_key(np.diff(own), *_set_sums(values, row, high - low))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.string())], ["doc_id", "text", "set_key"])

    several = chosen.join(again, "doc_id").select("doc_id", "text").mapInArrow(named, "doc_id long, text string, set_key string") \
        .join(classes.select(F.col("node").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi") \
        .dropDuplicates(["doc_id", "set_key"])
    return cut_lineage(single.select("doc_id", "text").union(several.select("doc_id", "text")))


def _same_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that has several different texts."""
    rows = signed.where("set_key is not null and doc_id is not null").select("doc_id", "set_key")
    several = rows.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high")
    nodes = rows.join(several.select("doc_id"), "doc_id").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("first"))
    return nodes.join(least, "doc_id").select("first", F.col("node").alias("second")).where("first <> second")


def _compare_blocks(large: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the members of large buckets that are not yet in one component."""
    nodes = large.groupBy("node", "component").agg(F.max("n").alias("n"))
    joined = large.select("bucket", "node").join(large.groupBy("bucket").agg(F.min("node").alias("least")), "bucket")
    clusters = connected_components(joined, "node", "least")
    placed = nodes.join(clusters.withColumnRenamed("component", "cluster"), "node", "left") \
        .withColumn("cluster", F.coalesce("cluster", "node"))
    largest = placed.groupBy("cluster", "component").count().groupBy("cluster") \
        .agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    placed = placed.join(largest, "cluster").withColumn("settled", F.col("component") == F.col("main"))
    weight = F.sum(F.greatest("n", F.lit(BLOCK_SHINGLES // BLOCK_TEXTS)))
    need = placed.groupBy("cluster", "settled").agg(F.ceil(weight / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = placed.join(need, ["cluster", "settled"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    counts = need.groupBy("cluster").agg(F.coalesce(F.max(F.when(~F.col("settled"), F.col("blocks"))), F.lit(0)).alias("open"),
                                         F.coalesce(F.max(F.when(F.col("settled"), F.col("blocks"))), F.lit(0)).alias("done"))
    # An unsettled block meets every unsettled block once, and every settled block.
    after = F.transform(F.sequence(F.lit(0), F.col("open") - 1), lambda x: F.struct(
        F.least("block", x).alias("low"), F.greatest("block", x).alias("high"), F.lit(False).alias("mixed")))
    mixed = F.when(F.col("done") > 0, F.transform(F.sequence(F.lit(0), F.col("done") - 1), lambda x: F.struct(
        F.col("block").alias("low"), x.alias("high"), F.lit(True).alias("mixed"))))
    with_main = F.transform(F.sequence(F.lit(0), F.col("open") - 1), lambda x: F.struct(
        x.alias("low"), F.col("block").alias("high"), F.lit(True).alias("mixed")))
    meets = F.when(F.col("settled"), with_main).otherwise(F.concat(after, F.coalesce(mixed, F.array_except(after, after))))
    dealt = placed.join(counts, "cluster").where("open > 0").select(
        F.col("node").alias("doc_id"), "component", "cluster", F.explode(meets).alias("meeting"))
    rows = texts.join(dealt, "doc_id").select("doc_id", "text", "component", "cluster", "meeting.*")
    key = ["cluster", "mixed", "low", "high"]
    run, schema = _block_links(width, percent)
    return rows.repartition(*key).sortWithinPartitions(*key, "doc_id").mapInArrow(run, schema)


def _block_links(width: int, percent: int):
    """Rows come sorted by meeting; each meeting gives a forest of the links between its texts."""
    schema = pa.schema([("first", pa.int64()), ("second", pa.int64())])

    def links(held):
        ids, components, sets = (list(x) for x in zip(*held))
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        different, column, spread = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = column.ravel()
        shared = spread[column] > 1
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.float64)
        for low in range(0, len(different), MATRIX_COLUMNS):
            a, b = np.searchsorted(column, [low, low + MATRIX_COLUMNS])
            if a < b:
                part = np.zeros((len(sets), MATRIX_COLUMNS), dtype=np.float32)
                part[row[a:b], column[a:b] - low] = 1
                common += part @ part.T
        either = size[:, None] + size[None, :] - common
        components = np.array(components)
        linked = (100 * common >= percent * either) & (common > 0) & (components[:, None] != components[None, :])
        first, second = np.nonzero(np.triu(linked, 1))
        ids = np.array(ids, dtype=np.int64)
        node, root = forest(ids[first], ids[second])
        return pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(node, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, meeting = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "mixed", "low", "high"))))
            ids, components = batch.column("doc_id").to_pylist(), batch.column("component").to_pylist()
            for low, high, values, _, own in shingle_sets(batch.column("text"), width):
                for i in range(low, high):
                    if keys[i] != meeting:
                        if held:
                            yield links(held)
                        held, meeting = [], keys[i]
                    held.append((ids[i], components[i], values[own[i - low]:own[i - low + 1]].copy()))
        if held:
            yield links(held)

    return run, "first long, second long"
