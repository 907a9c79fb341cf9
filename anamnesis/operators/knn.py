"""Exact nearest neighbours as one pass over the corpus.

A measured small query side travels to every task, the corpus streams past it in Arrow
batches, and each task keeps its own k best per query. Only queries x tasks x k rows shuffle.
A query side beyond the bound meets the corpus in hashed block pairs instead, in rounds of as many
query blocks as occupy the cores: a round copies the corpus once per block of it, and its copies go when it ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.vectors import cosine_distance
from anamnesis.operators.kernels import DISTANCE_DECIMALS, NearestRows, matrix, unit_rows
from anamnesis.operators.ranking import top_k
from anamnesis.operators.sizing import attach, fits_broadcast, measure, salt_of
from anamnesis.session import cut_lineage, read_tables, scratch, write_table

HIT_SCHEMA = "query_id string, memory_id string, chunk_index int, distance double"
QUERY_BLOCK_BYTES = 8 * 1024 * 1024
QUERY_BLOCK_ROWS = 16_384
CORPUS_BLOCK_BYTES = 128 * 1024 * 1024
#: Corpus rows that a task takes together.
SLICE_ROWS = 65_536
MOST_PARTITIONS = 4096
#: Query blocks of a round, at least.
ROUND_BLOCKS = 4


def knn_join(queries: DataFrame, chunks: DataFrame, k: int, allowed: DataFrame | None = None,
             query_block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """`k` nearest chunks per query: (query_id, memory_id, chunk_index, distance, rank).

    `queries` has query_id and query_vector; `chunks` has memory_id, chunk_index and vector.
    `allowed` restricts the corpus to its memory_ids before any distance is computed.
    """
    if allowed is not None:
        chunks = attach(chunks, allowed.select("memory_id").distinct(), "memory_id", "left_semi", even=True)
    wanted = queries.select(F.col("query_id").cast("string").alias("query_id"), "query_vector")
    corpus = chunks.select("memory_id", F.col("chunk_index").cast("int").alias("chunk_index"), "vector")
    if fits_broadcast(wanted, QUERY_BLOCK_ROWS, query_block_bytes):
        local = _against_broadcast(wanted, corpus, k)
    else:
        local = _by_block_pairs(wanted, corpus, k, query_block_bytes)
    return rank_hits(local, k)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, ["query_id"], [F.asc("distance"), F.asc("memory_id"), F.asc("chunk_index")], k)


def blocks_of(rows: DataFrame, block_bytes: int, block_rows: int | None = None) -> int:
    count, size = measure(rows)
    return max(1, math.ceil(size / block_bytes), math.ceil(count / block_rows) if block_rows else 1)


def dealt(rows: DataFrame, pairs: int, first: str, second: str) -> DataFrame:
    """Rows spread by their block pair. The number of partitions is fixed: the bytes of a pair say
    nothing of its arithmetic, so pairs must not be put together because they are small."""
    return rows.repartition(min(pairs, MOST_PARTITIONS), first, second)


def rounds_of(spark: SparkSession, left_blocks: int, right_blocks: int) -> list[range]:
    """The left blocks of each round. Every block of a round gets its own copy of the right side."""
    step = max(ROUND_BLOCKS, math.ceil(2 * spark.sparkContext.defaultParallelism / right_blocks))
    return [range(low, min(low + step, left_blocks)) for low in range(0, left_blocks, step)]


def in_rounds(left: DataFrame, right: DataFrame, block: str, rounds: list[range],
              meet: Callable[[DataFrame, DataFrame, range], DataFrame],
              reduced: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """What `meet` gives for the left rows of every round, in which `block` numbers their blocks. Several
    rounds are written one by one, as far as `reduced` leaves of them."""
    if len(rounds) == 1:
        return meet(left, right, rounds[0])
    spark = left.sparkSession
    with scratch(spark):
        left, right = cut_lineage(left), cut_lineage(right)
        found = [reduced(meet(left.where(F.col(block).between(some[0], some[-1])), right, some)) for some in rounds]
        paths = [write_table(one) for one in found]
    return read_tables(found[0], paths)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.Table]:
    """Arrow batches put together to about `rows` rows."""
    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def add_rows(state: NearestRows, rows: pa.Table, units: np.ndarray | None = None, **how: object) -> None:
    units = unit_rows(matrix(rows["vector"])) if units is None else units
    state.add(rows["memory_id"].combine_chunks(), rows["chunk_index"].combine_chunks(), units, **how)


def _against_broadcast(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    table = queries.toArrow()
    shared = corpus.sparkSession.sparkContext.broadcast(
        (table["query_id"].combine_chunks(), unit_rows(matrix(table["query_vector"]))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_units = shared.value
        if not len(query_ids):
            return
        state = NearestRows(query_units, k)
        for part in in_slices(batches):
            add_rows(state, part)
        yield from state.table(query_ids).to_batches()

    return corpus.mapInArrow(nearest, HIT_SCHEMA)


def _by_block_pairs(queries: DataFrame, corpus: DataFrame, k: int, query_block_bytes: int) -> DataFrame:
    query_blocks = blocks_of(queries, query_block_bytes, QUERY_BLOCK_ROWS)
    corpus_blocks = blocks_of(corpus, CORPUS_BLOCK_BYTES)
    left = queries.withColumn("_q", salt_of(["query_id", "query_vector"], query_blocks))
    right = corpus.withColumn("_c", salt_of(["memory_id", "chunk_index", "vector"], corpus_blocks))

    def nearest(query_rows: pa.Table, corpus_rows: pa.Table) -> pa.Table:
        state = NearestRows(unit_rows(matrix(query_rows["query_vector"])), k)
        for start in range(0, corpus_rows.num_rows, SLICE_ROWS):
            add_rows(state, corpus_rows.slice(start, SLICE_ROWS))
        return state.table(query_rows["query_id"].combine_chunks())

    def meet(some_queries: DataFrame, corpus_rows: DataFrame, some: range) -> DataFrame:
        asked = some_queries.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1))))
        copies = corpus_rows.withColumn("_q", F.explode(F.sequence(F.lit(some[0]), F.lit(some[-1]))))
        pairs = len(some) * corpus_blocks
        return (dealt(asked, pairs, "_q", "_c").groupBy("_q", "_c")
                .cogroup(dealt(copies, pairs, "_q", "_c").groupBy("_q", "_c")).applyInArrow(nearest, HIT_SCHEMA))

    # Rows of one query id may stand in several rounds: what is left of each is ranked again.
    return in_rounds(left, right, "_q", rounds_of(corpus.sparkSession, query_blocks, corpus_blocks), meet,
                     lambda hits: rank_hits(hits, k).drop("rank"))


def knn_per_haystack(questions: DataFrame, haystack: DataFrame, k: int) -> DataFrame:
    """Nearest documents of each question inside its own haystack.

    `questions` has query_id and query_vector (one row per question), `haystack` has query_id,
    memory_id and vector. Each haystack row meets exactly one question, so the join is linear in
    the haystack and the arithmetic stays in the JVM.
    """
    paired = attach(haystack, questions.select("query_id", "query_vector"), "query_id")
    scored = paired.select(
        "query_id", "memory_id", F.lit(0).alias("chunk_index"),
        F.round(cosine_distance("vector", "query_vector"), DISTANCE_DECIMALS).alias("distance"))
    return rank_hits(scored, k)


