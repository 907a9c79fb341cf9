"""Inverted lists beside a store: the terms of its chunks and the trigrams of its texts.

A list table is partitioned by a hash of its key, so a request reads the partitions of the keys it
asks for and no other. A change adds rows and a list of ids that are gone; it rewrites nothing.
Rows of an id that went in a later change than theirs are skipped when read. `compact` writes all live
rows as a new base. Frequencies are differences per change and add up to those of a rebuild.

A change counts once its entry stands in the log; what an interrupted one left is overwritten by
the next. The number of changes behind a base, and so of folders a reader lists, is bounded by compaction.

A trigram stands in a large part of all texts, so its list is kept in blocks: memories are dealt into blocks
of bounded size by a hash of their id, and a row holds the places of a trigram in one block. `blocks` names them.
Lists of terms are kept likewise, over chunks: `pieces` names these, with their lengths. Frequencies of what comes in
are summed from the lists just written, and not from the texts once more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from anamnesis.constants import TRIGRAM_SIZE
from anamnesis.functions.core import is_row, rows_of
from anamnesis.functions.grams import distinct_pairs, names_of, windows
from anamnesis.functions.grams import pieces as pieces_of
from anamnesis.functions.text import tokenize, trigrams
from anamnesis.operators.bm25 import bm25_from_index, chunk_tokens, query_terms
from anamnesis.operators.search import trigram_index
from anamnesis.operators.sizing import attach, fits_broadcast, measure, salted_join
from anamnesis.session import cut_lineage, ensure_checkpoint_dir, shuffles_dropped

TABLES = {
    "terms": "term string, block bigint, places array<int>, tfs array<int>",
    "pieces": "block bigint, chunks array<struct<memory_id:string,chunk_index:int,doc_len:int>>",
    "trigrams": "trigram string, block bigint, places array<int>",
    "blocks": "block bigint, memory_ids array<string>",
    "term_counts": "term string, n bigint",
    "trigram_counts": "trigram string, n bigint",
    "totals": "n_docs bigint, total_len bigint",
    "gone": "memory_id string",
}
KEYS = {"terms": "term", "trigrams": "trigram", "term_counts": "term", "trigram_counts": "trigram"}
PARTS = 64
COMPACT_AFTER = 16
#: A change whose texts are smaller than this adds one piece per table, which every request reads.
SMALL_CHANGE_BYTES = 16 * 1024 * 1024
TASK_BYTES = 256 * 1024 * 1024
UNPARTED = -1
#: Texts and memories of a block of the trigram lists, which one task groups.
BLOCK_BYTES = 8 * 1024 * 1024
BLOCK_ROWS = 4096
CHUNK_ORDER = ["memory_id", "chunk_index", "doc_len"]
MOST_PARTITIONS = 4096


def block_lists(block: tuple, rows: pa.Table) -> pa.Table:
    """(trigram, block, places) of one block: places count its distinct memory ids in their order."""
    ids = pc.unique(rows["memory_id"].combine_chunks())
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[pc.index_in(rows["memory_id"].combine_chunks(), ids).to_numpy(zero_copy_only=False)]
    texts = rows["text"].combine_chunks()
    pairs, known = [], np.zeros(0, np.int64)
    for first, count in pieces_of(texts):
        row, name, own = distinct_pairs(*windows(texts.slice(first, count)))
        known, name = _numbered(known, own, name)
        pairs.append((name, place[first + row]))
    name, place = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    # An id with several texts stands in a list once per text that has the trigram.
    order = np.argsort(name * max(len(ids), 1) + place)
    starts, lists = _lists(name[order], place[order])
    return pa.table({"trigram": names_of(known).take(pa.array(name[order][starts])),
                     "block": pa.array(np.full(len(starts), block[0].as_py()), pa.int64()), "places": lists[0]})


def _numbered(known: np.ndarray, own: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all distinct keys so far, numbers of `name` among them), where `name` counts the keys `own`."""
    joined = pa.array(np.concatenate([known, own])).dictionary_encode()  # numbers are given in order of appearance
    return (joined.dictionary.to_numpy(zero_copy_only=False),
            joined.indices.to_numpy(zero_copy_only=False)[len(known):].astype(np.int64)[name])


def _lists(name: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.ListArray]]:
    """(where each name begins, its lists) of rows sorted by name."""
    starts = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(name)), pa.int32())
    return starts, [pa.ListArray.from_arrays(offsets, pa.array(column, pa.int32())) for column in columns]


def block_terms(block: tuple, rows: pa.Table) -> pa.Table:
    """(term, block, places, tfs) of one block: places count its chunks in the order of `CHUNK_ORDER`."""
    sort = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in CHUNK_ORDER], null_placement="at_start")
    place = np.empty(len(sort), np.int64)
    place[sort.to_numpy()] = np.arange(len(sort))
    tokens = rows["tokens"].combine_chunks()
    lengths = np.maximum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), 0)
    coded = tokens.flatten().dictionary_encode()
    pairs = np.sort(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(sort), 1) + np.repeat(place, lengths))
    heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    name, place = np.divmod(pairs[heads], max(len(sort), 1))
    starts, lists = _lists(name, place, np.diff(np.append(heads, len(pairs))))
    return pa.table({"term": coded.dictionary.take(pa.array(name[starts])).cast(pa.string()),
                     "block": pa.array(np.full(len(starts), block[0].as_py()), pa.int64()), "places": lists[0], "tfs": lists[1]})


class StoredIndex:
    """The index under `root`. `parts` is fixed when it is built."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    # Log ----------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def log(self) -> list[tuple[int, bool]]:
        """(number, whether it is a base) of every change that counts, from the last base on."""
        fs, pattern = self._fs(f"{self.root}/log/*")
        names = sorted(s.getPath().getName() for s in (fs.globStatus(pattern) or []))
        entries = [(int(n.split(".")[0]), n.endswith(".base")) for n in names]
        last = max((i for i, (_, base) in enumerate(entries) if base), default=len(entries))
        return entries[last:]

    def exists(self) -> bool:
        return bool(self.log())

    def commit(self, number: int, base: bool = False) -> None:
        """The change counts from here on; once more is no error."""
        fs, marker = self._fs(f"{self.root}/log/{number:08d}{'.base' if base else '.added'}")
        fs.create(marker, True).close()

    # Writing ------------------------------------------------------------------------------

    def _part(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _write(self, name: str, rows: DataFrame, number: int, text_bytes: int) -> None:
        fields = [f.split()[0] for f in TABLES[name].split(", ")]
        rows, path = rows.select(*fields), f"{self.root}/{name}/change={number}"
        with shuffles_dropped(self.spark):
            self._write_rows(name, rows, path, text_bytes)

    def _write_rows(self, name: str, rows: DataFrame, path: str, text_bytes: int) -> None:
        if name not in KEYS or text_bytes <= SMALL_CHANGE_BYTES:
            rows.withColumn("part", F.lit(UNPARTED)).coalesce(1 if text_bytes <= SMALL_CHANGE_BYTES else 64) \
                .write.mode("overwrite").partitionBy("part").parquet(path)
            return
        # A hot key's list is written by as many tasks as the whole needs; a partition's files are sorted by key.
        spread = max(1, math.ceil(text_bytes / (self.parts * TASK_BYTES)))
        turn = F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
        rows.withColumn("part", self._part(KEYS[name])).repartition(self.parts * spread, "part", turn) \
            .sortWithinPartitions("part", KEYS[name]).write.mode("overwrite").partitionBy("part").parquet(path)

    def _write_trigrams(self, memories: DataFrame, number: int, text_bytes: int) -> None:
        """Texts move once, to the task of their block; what leaves it are places, not ids."""
        texts = memories.select("memory_id", "text").where("memory_id IS NOT NULL")
        rows, size = measure(texts)
        blocks = max(1, math.ceil(rows / BLOCK_ROWS), math.ceil(size / BLOCK_BYTES))
        dealt = texts.withColumn("block", F.pmod(F.xxhash64("memory_id"), F.lit(blocks)))
        together = dealt.repartition(min(blocks, MOST_PARTITIONS), "block")
        lists = together.select("block", "memory_id", "text").groupBy("block").applyInArrow(block_lists, TABLES["trigrams"])
        self._write("trigrams", lists, number, text_bytes)
        names = dealt.groupBy("block").agg(F.array_sort(F.collect_set("memory_id")).alias("memory_ids"))  # bounded blocks
        self._write("blocks", names, number, text_bytes)

    def _write_terms(self, chunks: DataFrame, number: int, text_bytes: int) -> None:
        """As with trigrams. Chunks are dealt by id and index, so that a memory of many is no block by itself."""
        rows, size = measure(chunks.select("memory_id", "text"))
        blocks = max(1, math.ceil(rows / BLOCK_ROWS), math.ceil(size / BLOCK_BYTES))
        place = F.col("chunk_index").cast("int").alias("chunk_index")
        dealt = chunks.select("memory_id", place, "text").withColumn(
            "block", F.pmod(F.xxhash64("memory_id", "chunk_index"), F.lit(blocks)))
        tokens = dealt.select("block", "memory_id", "chunk_index", tokenize("text").alias("tokens"))
        named = tokens.select("block", "memory_id", "chunk_index", F.size("tokens").alias("doc_len"))
        self._write("pieces", named.groupBy("block").agg(
            F.array_sort(F.collect_list(F.struct(*CHUNK_ORDER))).alias("chunks")), number, text_bytes)  # bounded blocks
        lists = dealt.repartition(min(blocks, MOST_PARTITIONS), "block").select(
            "block", "memory_id", "chunk_index", tokenize("text").alias("tokens")).withColumn("doc_len", F.size("tokens"))
        self._write("terms", lists.groupBy("block").applyInArrow(block_terms, TABLES["terms"]), number, text_bytes)

    def _came(self, name: str, number: int) -> DataFrame:
        """Rows of a table that change `number` has just written."""
        return self.spark.read.schema(f"{TABLES[name]}, part int").parquet(f"{self.root}/{name}/change={number}")

    def build(self, chunks: DataFrame, memories: DataFrame) -> None:
        """A new base from whole tables."""
        nobody = self.spark.createDataFrame([], TABLES["gone"])
        self._add(self._next(), nobody, chunks, memories, chunks.limit(0), memories.limit(0), base=True)

    def prepare(self, gone: DataFrame, chunks: DataFrame, memories: DataFrame, old_chunks: DataFrame,
                old_memories: DataFrame) -> int:
        """Write what a change adds and takes; it counts after `commit`. `old_*` are the stored rows
        of the ids in `gone`; a replaced memory is in both, and its new rows stay."""
        number = self._next()
        self._add(number, gone, chunks, memories, old_chunks, old_memories, base=False)
        return number

    def _next(self) -> int:
        return max((n for n, _ in self.log()), default=0) + 1

    def _add(self, number: int, gone: DataFrame, chunks: DataFrame, memories: DataFrame, old_chunks: DataFrame,
             old_memories: DataFrame, base: bool) -> None:
        size = measure(chunks.select("text"))[1] + measure(old_chunks.select("text"))[1]
        self._write_terms(chunks, number, size)
        self._write_trigrams(memories, number, size)
        lost = chunk_tokens(old_chunks)
        terms = lost.select(rows_of(F.array_distinct("tokens"), "term")).where(is_row("term"))
        self._write("term_counts", _moves(self._came("terms", number), terms, "term"), number, size)
        self._write("trigram_counts", _moves(self._came("trigrams", number), trigram_index(old_memories.where("memory_id IS NOT NULL")),
                                             "trigram"), number, size)
        came = self._came("pieces", number).select(rows_of(F.col("chunks"), "c")).where(is_row("c")).select("c.doc_len")
        totals = _totals(came, 1).unionByName(_totals(lost.select(F.size("tokens").alias("doc_len")), -1))
        self._write("totals", totals.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")), number, 0)
        self._write("gone", gone.select("memory_id").distinct(), number, size)
        if base:
            self.commit(number, base=True)

    def compact(self) -> None:
        """All live rows as a new base; changes before the last base are removed."""
        before, number = self.log(), self._next()
        size = measure(self._rows("terms"))[1]
        self._compact_terms(number, size)
        self._compact_trigrams(number, size)
        for name, key in (("term_counts", "term"), ("trigram_counts", "trigram")):
            self._write(name, self._rows(name).groupBy(key).agg(F.sum("n").alias("n")).where("n <> 0"), number, size)
        self._write("totals", self.corpus().select("n_docs", "total_len"), number, 0)
        self._write("gone", self.spark.createDataFrame([], TABLES["gone"]), number, 0)
        self.commit(number, base=True)
        for name in TABLES:
            fs, pattern = self._fs(f"{self.root}/{name}/change=*")
            for status in fs.globStatus(pattern) or []:
                if int(status.getPath().getName().split("=")[1]) < before[0][0]:
                    fs.delete(status.getPath(), True)

    def _compact_terms(self, number: int, text_bytes: int) -> None:
        """Blocks of chunks stay as they are too, with live chunks only."""
        in_block = Window.partitionBy("change", "block").orderBy("place")
        named = self._chunks().withColumn("new_place", (F.row_number().over(in_block) - 1).cast("int"))
        moved = cut_lineage(named.join(F.broadcast(self._renumbered("pieces")), ["change", "block"]))
        rows = self._rows("terms").select("term", "change", "block", F.explode(F.arrays_zip("places", "tfs")).alias("t"))
        kept = rows.select("term", "change", "block", F.col("t.places").alias("place"), "t.tfs").join(
            moved.select("change", "block", "place", "new_place", "number"), ["change", "block", "place"])
        lists = kept.groupBy("term", F.col("number").alias("block")).agg(F.array_sort(F.collect_list(F.struct("new_place", "tfs"))).alias("l"))
        self._write("terms", lists.select("term", "block", F.col("l.new_place").alias("places"), F.col("l.tfs").alias("tfs")),
                    number, text_bytes)
        self._write("pieces", moved.groupBy(F.col("number").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct(*CHUNK_ORDER))).alias("chunks")), number, text_bytes)

    def _renumbered(self, name: str) -> DataFrame:
        """(change, block, number): one number for every block of all changes."""
        held = sorted((r["change"], r["block"]) for r in self._rows(name).select("change", "block").toLocalIterator())
        return self.spark.createDataFrame([(*key, i) for i, key in enumerate(held)], "change int, block bigint, number bigint")

    def _compact_trigrams(self, number: int, text_bytes: int) -> None:
        """Blocks stay as they are, under numbers of their own, with the places of live memories only."""
        in_block = Window.partitionBy("change", "block").orderBy("memory_id")
        named = self._names().withColumn("new_place", F.row_number().over(in_block) - 1)
        moved = cut_lineage(named.join(F.broadcast(self._renumbered("blocks")), ["change", "block"]))
        places = self._rows("trigrams").select("trigram", "change", "block", F.explode("places").alias("place")).join(
            moved.select("change", "block", "place", "new_place", "number"), ["change", "block", "place"])
        lists = places.groupBy("trigram", F.col("number").alias("block")).agg(
            F.array_sort(F.collect_list(F.col("new_place").cast("int"))).alias("places"))
        self._write("trigrams", lists, number, text_bytes)
        self._write("blocks", moved.groupBy(F.col("number").alias("block")).agg(
            F.array_sort(F.collect_set("memory_id")).alias("memory_ids")), number, text_bytes)

    def compact_if_due(self, after: int = COMPACT_AFTER) -> None:
        if len(self.log()) > after:
            self.compact()

    # Reading ------------------------------------------------------------------------------

    def _rows(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """Rows of the changes that count; with `parts`, of these partitions only."""
        schema = f"{TABLES[name]}, change int, part int"
        paths = [f"{self.root}/{name}/change={n}" for n, _ in self.log()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows if parts is None else rows.where(F.col("part").isin([*parts, UNPARTED]))

    def live(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """Rows whose memory did not go in a later change. Trigrams come as (trigram, memory_id), terms as
        (term, memory_id, chunk_index, tf, doc_len)."""
        rows = self._rows(name, parts)
        if name == "terms":
            ensure_checkpoint_dir(self.spark)
            return self._postings(rows, self._chunks().checkpoint())  # the lists stay the only files that rows come from
        if name == "trigrams":
            places = rows.select("trigram", "change", "block", F.explode("places").alias("place"))
            return places.join(self._names(), ["change", "block", "place"]).select("trigram", "memory_id")
        return self._not_gone(rows).drop("change", "part")

    def _chunks(self) -> DataFrame:
        """(change, block, place, memory_id, chunk_index, doc_len) of the live chunks."""
        rows = self._rows("pieces").select("change", "block", F.posexplode("chunks").alias("place", "c"))
        return self._not_gone(rows.select("change", "block", "place", *[f"c.{field}" for field in CHUNK_ORDER]))

    def _postings(self, lists: DataFrame, chunks: DataFrame) -> DataFrame:
        """(term, memory_id, chunk_index, tf, doc_len): lists meet the names of their blocks by numbers."""
        rows = lists.select("term", "change", "block", F.explode(F.arrays_zip("places", "tfs")).alias("t")).select(
            "term", "change", "block", F.col("t.places").alias("place"), F.col("t.tfs").alias("tf"))
        return attach(rows, chunks, ["change", "block", "place"], even=True).select("term", "memory_id", "chunk_index", "tf", "doc_len")

    def _names(self) -> DataFrame:
        """(change, block, place, memory_id) of the live memories."""
        rows = self._rows("blocks").select("change", "block", F.posexplode("memory_ids").alias("place", "memory_id"))
        return self._not_gone(rows)

    def _not_gone(self, rows: DataFrame) -> DataFrame:
        if len(self.log()) < 2:
            return rows
        gone = self._rows("gone").groupBy("memory_id").agg(F.max("change").alias("went"))
        kept = attach(rows, gone, "memory_id", "left", even=True, computed=True)
        return kept.where(F.col("went").isNull() | (F.col("change") >= F.col("went"))).drop("went")

    def _parts_of(self, keys: DataFrame, key: str) -> list[int]:
        return sorted(r["part"] for r in keys.select(self._part(key).alias("part")).distinct().collect())  # at most `parts`

    def corpus(self) -> DataFrame:
        """One row: n_docs, total_len, avgdl."""
        return self._rows("totals").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")) \
            .withColumn("avgdl", F.col("total_len") / F.nullif("n_docs", F.lit(0)))

    def counts(self, keys: DataFrame, key: str) -> DataFrame:
        """(key, df) of the asked keys (distinct, measured small)."""
        asked = self._rows(f"{key}_counts", self._parts_of(keys, key)).join(F.broadcast(keys), key, "left_semi")
        return asked.groupBy(key).agg(F.sum("n").alias("df")).where("df > 0")

    def bm25(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """`k` best chunks per query, as `bm25_join` over the indexed chunks gives them."""
        asked = query_terms(queries).select("term").distinct()
        if not fits_broadcast(asked):
            frequency = self._rows("term_counts").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
            return bm25_from_index(queries, self.live("terms"), frequency, self.corpus(), k, allowed)
        asked = cut_lineage(asked)
        lists = self._rows("terms", self._parts_of(asked, "term")).join(F.broadcast(asked), "term", "left_semi")
        postings = self._postings(lists, self._chunks())
        return bm25_from_index(queries, postings, self.counts(asked, "term"), self.corpus(), k, allowed)

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """(pattern_id, memory_id): memories that may hold a literal of three characters or more.

        The lists of a literal are intersected from the rarest on. As many are taken as should
        leave less than one memory by chance if trigrams were independent; every candidate is verified later, so
        the lists left out cost no answer. A trigram without a list leaves no candidate.
        """
        wanted = patterns.where(F.char_length("pattern") >= TRIGRAM_SIZE).select(
            "pattern_id", F.explode(trigrams("pattern")).alias("trigram"))
        wanted = cut_lineage(wanted)
        keys = cut_lineage(wanted.select("trigram").distinct())
        small = fits_broadcast(wanted)
        if small:
            counted = wanted.join(self.counts(keys, "trigram"), "trigram", "left")
        else:
            counts = self._rows("trigram_counts").groupBy("trigram").agg(F.sum("n").alias("df")).where("df > 0")
            counted = wanted.join(counts, "trigram", "left")
        chosen = rarest_first(counted, max(self.corpus().first().n_docs or 0, 1))
        needed = chosen.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("needed"))
        lists = cut_lineage(chosen.select("pattern_id", "trigram"))
        if small and not self._places_repeat():
            return self._in_blocks(lists).join(self._names(), ["change", "block", "place"]).select("pattern_id", "memory_id")
        if small:
            held = self._rows("trigrams", self._parts_of(lists.select("trigram").distinct(), "trigram")) \
                .join(F.broadcast(lists), "trigram")
        else:
            held = salted_join(self._rows("trigrams"), lists, ["trigram"])
        # Counted by numbers first; a name comes to a count and not to every place of a list.
        places = held.select("pattern_id", "change", "block", F.explode("places").alias("place"))
        counts = places.groupBy("pattern_id", "change", "block", "place").agg(F.count(F.lit(1)).alias("n"))
        found = counts.join(self._names(), ["change", "block", "place"]).groupBy("pattern_id", "memory_id").agg(
            F.sum("n").alias("held"))
        return attach(found, needed, "pattern_id", computed=True).where("held = needed").select("pattern_id", "memory_id")


    def _places_repeat(self) -> bool:
        """Whether a live memory stands in blocks of several changes; those of one change are dealt by its id."""
        if len(self.log()) < 2:
            return False
        places = self._names().groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
        return not places.where("n > 1").limit(1).isEmpty()

    def _in_blocks(self, lists: DataFrame) -> DataFrame:
        """(pattern_id, change, block, place) of the places that stand in every list of a pattern, lists of a
        block being met in its task. Only lists of places move, each once, whatever the number of patterns."""
        asked = lists.where("pattern_id IS NOT NULL").toArrow()
        ids, names = (asked[c].combine_chunks().dictionary_encode() for c in ("pattern_id", "trigram"))
        shared = self.spark.sparkContext.broadcast((ids.dictionary, names.dictionary, *(
            c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (ids, names))))

        def complete(block: tuple, rows: pa.Table) -> pa.Table:
            pattern_ids, trigram_names, patterns, numbers = shared.value
            places, pattern = common_places(rows["places"].combine_chunks(), pc.index_in(
                rows["trigram"].combine_chunks(), trigram_names).to_numpy(zero_copy_only=False), patterns, numbers, len(trigram_names))
            change, number = (pa.array(np.full(len(places), at.as_py()), kind) for at, kind in zip(block, (pa.int32(), pa.int64())))
            return pa.table({"pattern_id": pattern_ids.take(pa.array(pattern)).cast(pa.string()), "change": change, "block": number,
                             "place": pa.array(places, pa.int32())})

        wanted = F.broadcast(lists.select("trigram").distinct())
        held = self._rows("trigrams", self._parts_of(lists.select("trigram").distinct(), "trigram")).join(wanted, "trigram", "left_semi")
        return held.select("change", "block", "trigram", "places").groupBy("change", "block").applyInArrow(
            complete, "pattern_id string, change int, block bigint, place int")


def common_places(lists: pa.ListArray, list_numbers: np.ndarray, patterns: np.ndarray, numbers: np.ndarray,
                  names: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, pattern) wherever a place stands in the lists as often as the pattern asks for them in all. `patterns` and
    `numbers` have a row per pattern and list it asks for."""
    ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy().astype(np.int64)))
    flat = lists.flatten().to_numpy().astype(np.int64)
    row_of = np.full(names, -1, np.int64)
    row_of[list_numbers.astype(np.int64)] = np.arange(len(list_numbers))
    order = np.argsort(patterns, kind="stable")
    patterns, rows = patterns[order], row_of[numbers[order]]
    starts = np.flatnonzero(np.append(True, patterns[1:] != patterns[:-1])) if len(patterns) else np.zeros(0, np.int64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for first, stop in zip(starts, np.append(starts[1:], len(patterns))):
        own = rows[first:stop]
        if (own < 0).any():  # no text of the block holds that trigram
            continue
        counts = np.bincount(np.concatenate([flat[ends[r]:ends[r + 1]] for r in own]))
        places = np.flatnonzero(counts == stop - first)
        found.append((places, np.full(len(places), patterns[first])))
    return np.concatenate([p for p, _ in found]), np.concatenate([p for _, p in found])


def rarest_first(counted: DataFrame, total: int) -> DataFrame:
    """Of (pattern_id, trigram, df) the rarest trigrams of each pattern, until chance would leave
    less than one of `total` memories; none of a pattern with a trigram that has no list (null df)."""
    lists = counted.groupBy("pattern_id").agg(
        F.count_if(F.col("df").isNull()).alias("missing"),
        F.array_sort(F.collect_list(F.struct("df", "trigram"))).alias("lists"))  # as long as the pattern
    share = F.log(F.col("l.df").cast("double") / F.lit(float(total)))
    rows = lists.where("missing = 0").select("pattern_id", F.posexplode("lists").alias("place", "l"))
    before = Window.partitionBy("pattern_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum(share).over(before), F.lit(0.0)) + math.log(total)
    return rows.withColumn("left", left).where((F.col("place") == 0) | (F.col("left") >= 0)) \
        .select("pattern_id", F.col("l.trigram").alias("trigram"))


def _moves(came: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """(key, n): rows that came, which stand in lists, less rows that went."""
    both = came.select(key, F.size("places").alias("n")).unionByName(old.select(key, F.lit(-1).alias("n")))
    return both.groupBy(key).agg(F.sum("n").alias("n")).where("n <> 0")


def _totals(terms: DataFrame, sign: int) -> DataFrame:
    return terms.agg((sign * F.count(F.lit(1))).alias("n_docs"), (sign * F.coalesce(F.sum("doc_len"), F.lit(0))).alias("total_len"))
