"""From ranked chunk hits to ranked memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.constants import FUSED_DISTANCE_SPAN, OVERFETCH_FACTOR, OVERFETCH_FLOOR, RRF_K, RRF_LEG_DEPTH
from anamnesis.operators.ranking import top_k


def fetch_depth(k: int) -> int:
    """Chunk hits asked for before cut-off and collapse."""
    return max(OVERFETCH_FACTOR * k, OVERFETCH_FLOOR)


def leg_depth(k: int) -> int:
    return max(k, RRF_LEG_DEPTH)


def rrf_fuse(k: int, *legs: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of ranked legs: (query_id, memory_id, chunk_index, score, rank, distance).

    The output distance is a ramp below the relevance cut-off, so later stages keep every row.
    """
    columns = ["query_id", "memory_id", "chunk_index", "rank"]
    stacked = reduce(DataFrame.unionByName, [leg.select(*columns) for leg in legs])
    fused = (stacked.groupBy("query_id", "memory_id", "chunk_index")
             .agg(F.round(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))), 12).alias("score")))
    ranked = top_k(fused, ["query_id"], [F.desc("score"), F.asc("memory_id"), F.asc("chunk_index")], k)
    step = FUSED_DISTANCE_SPAN / max(1, k - 1)
    return ranked.withColumn("distance", F.round((F.col("rank") - 1) * step, 9))


def collapse_chunks(hits: DataFrame) -> DataFrame:
    """Each memory once per query, at its best hit and with that hit's chunk."""
    best = hits.groupBy("query_id", "memory_id").agg(
        F.min(F.struct("rank", "chunk_index", "distance")).alias("b"))
    return best.select("query_id", "memory_id", "b.rank", "b.chunk_index", "b.distance")


def best_memories(hits: DataFrame, k: int) -> DataFrame:
    """Collapse, then the `k` best memories per query with a dense new rank."""
    return top_k(collapse_chunks(hits).withColumnRenamed("rank", "hit_rank"), ["query_id"],
                 [F.asc("hit_rank"), F.asc("memory_id")], k).drop("hit_rank")


def recall_rows(hits: DataFrame, chunks: DataFrame, memories: DataFrame, bounded: bool) -> DataFrame:
    """Attach chunk text, tags, conversation and chunk count; hits without a stored row drop out.

    `bounded` says that the query side was measured: hits are then at most queries x k narrow
    rows, which are sent to both stored tables. What is left of these, as many rows with texts, is
    joined by a shuffle: texts are not broadcast.
    """
    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if bounded else df

    with_text = chunks.select("memory_id", "chunk_index", "text").join(small(hits), ["memory_id", "chunk_index"])
    about = memories.select("memory_id", "conversation_id", "tags", "chunk_count").join(
        small(hits.select("memory_id").distinct()), "memory_id", "left_semi")
    return about.join(with_text, "memory_id").select(
        "query_id", "rank", "memory_id", "conversation_id", "tags", "text", "chunk_index", "chunk_count", "distance")
