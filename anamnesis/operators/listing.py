"""Listings, summaries and single-memory reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.constants import LIST_K
from anamnesis.functions.core import iso_millis
from anamnesis.operators.filters import MetaFilter, meta_filter
from anamnesis.operators.ranking import top_k
from anamnesis.operators.sizing import attach


def newest_first():
    return [F.desc("updated_at"), F.asc("memory_id")]


def recent(memories: DataFrame, k: int = LIST_K, wanted: MetaFilter | None = None) -> DataFrame:
    """Newest memories first under a filter; at least one row is always asked for."""
    return meta_filter(memories, wanted).orderBy(*newest_first()).limit(max(1, k))


def in_range(memories: DataFrame, start: str | None, end: str | None, k: int = LIST_K) -> DataFrame:
    return recent(memories, k, MetaFilter(start=start, end=end))


def by_tags(memories: DataFrame, tags: list[str], k: int = LIST_K) -> DataFrame:
    return recent(memories, k, MetaFilter(tags=tuple(tags)))


def list_ranked(queries: DataFrame, ranked: DataFrame, memories: DataFrame, k: int = LIST_K,
                wanted: MetaFilter | None = None) -> DataFrame:
    """Per query: its relevant memories first, then the newest others, up to `k`.

    A query reorders the filtered set and never narrows it. At most k memories per query are
    ranked, so the fill needs only the 2k newest allowed rows, which are shared by all queries.
    """
    pool = recent(memories, 2 * k, wanted).select("memory_id", "updated_at")
    pool_array = pool.agg(F.collect_list(F.struct("memory_id", "updated_at"))).scalar()
    first = (ranked.where(F.col("rank") <= k)
             .select("query_id", "memory_id", F.lit(0).alias("part"), F.col("rank").cast("bigint").alias("place")))
    fill = (queries.select("query_id", F.explode(pool_array).alias("m"))
            .select("query_id", "m.memory_id", F.lit(1).alias("part"),
                    (-F.unix_micros("m.updated_at")).alias("place"))
            .join(first.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti"))
    return top_k(first.unionByName(fill), ["query_id"],
                 [F.asc("part"), F.asc("place"), F.asc("memory_id")], k).drop("place")


def memory_texts(memory_ids: DataFrame, chunks: DataFrame, separator: str = " ") -> DataFrame:
    """Full text of the given memories: their chunks in order."""
    picked = attach(chunks.select("memory_id", "chunk_index", "text"),
                    memory_ids.select("memory_id").distinct(), "memory_id", "left_semi", even=True)
    ordered = picked.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return ordered.select("memory_id", F.array_join("c.text", separator).alias("text"))


def memory_detail(memory_ids: DataFrame, memories: DataFrame, chunks: DataFrame) -> DataFrame:
    """Full rows of given ids; unknown ids give no row."""
    wanted = memory_ids.select("memory_id").distinct()
    meta = attach(memories.select("memory_id", "conversation_id", "parent_id", "tags", "created_at"),
                  wanted, "memory_id", "left_semi", even=True)
    return (meta.join(memory_texts(wanted, chunks), "memory_id")
            .withColumn("created_at", iso_millis("created_at")))


def tag_counts(memories: DataFrame) -> DataFrame:
    """Memories per tag; a tag repeated inside one memory counts once."""
    return (memories.select(F.explode(F.array_distinct("tags")).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("memories"))
            .orderBy(F.collate("tag", "UNICODE"), "tag"))


def conversation_summary(memories: DataFrame) -> DataFrame:
    """Size and earliest time of every conversation, newest first."""
    return (memories.where(F.col("conversation_id").isNotNull() & (F.col("conversation_id") != ""))
            .groupBy("conversation_id")
            .agg(F.count(F.lit(1)).alias("memories"), F.min("created_at").alias("earliest"))
            .orderBy(F.desc("earliest"), "conversation_id"))


def conversation_entries(memories: DataFrame, conversation_ids: DataFrame | None = None) -> DataFrame:
    """Entries in (created_at, id) order; a parent shared inside the conversation is a fork.

    Fork points are found by a partial aggregate and joined back, so no task has to hold a
    whole conversation. The sort key starts with the conversation but includes time and id,
    so one long conversation spreads over many range partitions.
    """
    if conversation_ids is not None:
        memories = attach(memories, conversation_ids.select("conversation_id").distinct(),
                          "conversation_id", "left_semi")
    memories = memories.where(F.col("conversation_id").isNotNull())
    forks = (memories.where(F.coalesce(F.col("parent_id"), F.lit("")) != "")
             .groupBy("conversation_id", "parent_id").count().where("count > 1")
             .select("conversation_id", "parent_id", F.col("parent_id").alias("fork_from")))
    return (attach(memories, forks, ["conversation_id", "parent_id"], "left", computed=True)
            .select("conversation_id", "memory_id", "created_at", "text", "fork_from")
            .orderBy("conversation_id", "created_at", "memory_id"))


def store_summary(memories: DataFrame) -> DataFrame:
    """Rows and bytes of text."""
    return memories.agg(F.count(F.lit(1)).alias("rows"),
                        F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("bytes"))
