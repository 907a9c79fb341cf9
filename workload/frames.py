"""The given tables in the roles of memories, chunks, queries and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.ids import to_uuid
from anamnesis.functions.text import role_line
from anamnesis.session import pin_utc

EPOCH_SECONDS = 1_704_067_200  # 2024-01-01T00:00:00Z


KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id", "embeddings": "vec_id",
        "events": "event_id"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A file with too few splits to occupy the cores is spread by its key."""
    pin_utc(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in KEYS and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores, KEYS[name])
    return table


def minutes_after_epoch(minutes):
    return F.timestamp_seconds(F.lit(EPOCH_SECONDS) + minutes.cast("bigint") * 60)


def conversation_id(conv_id="conv_id"):
    return to_uuid(F.concat(F.lit("conv:"), F.col(conv_id).cast("string")))


def turn_id(conv_id="conv_id", turn="turn"):
    turn = F.col(turn) if isinstance(turn, str) else turn
    return to_uuid(F.concat(F.lit("conv:"), F.col(conv_id).cast("string"), F.lit(":"), turn.cast("string")))


def document_id(doc_id="doc_id"):
    return to_uuid(F.concat(F.lit("doc:"), F.col(doc_id).cast("string")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as memories: parent is the turn before, time is conv_id hours + turn minutes."""
    return turn_rows(load(spark, sf_dir, "conversations"))


def turn_rows(raw: DataFrame) -> DataFrame:
    at = minutes_after_epoch(F.col("conv_id") * 60 + F.col("turn"))
    return raw.select(
        turn_id().alias("memory_id"),
        conversation_id().alias("conversation_id"),
        F.when(F.col("turn") > 0, turn_id(turn=F.col("turn") - 1)).alias("parent_id"),
        F.col("turn").cast("int").alias("turn_index"),
        F.array(F.concat(F.lit("role:"), "role")).alias("tags"),
        role_line("role", "text").alias("text"),
        at.alias("created_at"),
        at.alias("updated_at"),
        "role",
    )


def document_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tagged memories; labels add `quality` and `toxic`."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    at = minutes_after_epoch(F.col("doc_id"))
    flags = F.concat(
        F.when(F.col("quality") == 1, F.array(F.lit("quality"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")),
    )
    return docs.join(labels, "doc_id", "left").select(
        document_id().alias("memory_id"),
        F.lit(None).cast("string").alias("conversation_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("int").alias("turn_index"),
        F.concat(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")), flags)
        .alias("tags"),
        "text",
        at.alias("created_at"),
        at.alias("updated_at"),
        "doc_id",
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one pre-split chunk."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(document_id().alias("memory_id"), F.lit(0).alias("chunk_index"), "text")


def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("memory_id", F.lit(0).alias("chunk_index"), "text")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "benchmark")
    return raw.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"),
                      F.col("text").alias("query_text"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks; four consecutive vectors belong to one memory."""
    raw = load(spark, sf_dir, "embeddings")
    return raw.select(
        F.concat(F.lit("m"), F.lpad(F.floor(F.col("vec_id") / 4).cast("string"), 8, "0")).alias("memory_id"),
        (F.col("vec_id") % 4).cast("int").alias("chunk_index"),
        F.col("embedding").alias("vector"),
        "label",
        "vec_id",
    )
