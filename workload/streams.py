"""Structured Streaming over the given tables as file sources. Each run gets a folder of its own
below the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.ids import content_etag, text_sha256
from anamnesis.plans.write import MEMORY_COLUMNS
from anamnesis.session import ensure_checkpoint_dir, pin_utc
from anamnesis.store import Store
from anamnesis.streaming.jobs import stream_dedup, stream_reconcile, stream_table_ingest
from workload import frames as W
from workload import sqltext as Q
from workload.registry import query
from workload.text import CHUNK_SQL


def run_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def conversation_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files. A pattern, unlike a path, may name either."""
    pin_utc(spark)
    raw = spark.readStream.schema("conv_id bigint, turn bigint, role string, text string").parquet(
        f"{sf}/conversations.parque[t]")
    return W.turn_rows(raw)


def as_turns(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("chat").alias("source"), "conversation_id", "memory_id", "parent_id",
                       F.col("turn_index").cast("bigint").alias("turn_index"), "text", "created_at", "tags",
                       F.lit(None).cast("timestamp").alias("fallback_at"))


TURN_CHUNKS = CHUNK_SQL.replace(f"SELECT {Q.DOC} AS memory_id, text FROM documents",
                                f"SELECT {Q.TURN} AS memory_id, upper(role)||': '||text AS text FROM conversations")


@query("stream_ingest",
       f"""{TURN_CHUNKS}, {Q.TURNS}, whole AS (SELECT memory_id, string_agg(text, chr(10) ORDER BY chunk_index) AS t FROM chunked GROUP BY 1)
       SELECT memory_id, conversation_id, md5(t) AS text_md5, tag AS tags FROM whole JOIN turns USING (memory_id)""")
def stream_ingest_all(spark: SparkSession, sf: str) -> DataFrame:
    """The transcript is streamed into a store twice; the second pass adds nothing."""
    root = run_folder(spark)
    store = Store(spark, f"{root}/store", buckets=8)
    for turn in (1, 2):
        stream_table_ingest(as_turns(conversation_stream(spark, sf)), store, f"{root}/offsets-{turn}").awaitTermination()
    return store.read("memories").select("memory_id", "conversation_id", F.md5("text").alias("text_md5"),
                                         F.array_join("tags", ",").alias("tags"))


@query("stream_dedup", f"WITH {Q.TURNS} SELECT memory_id, md5(text) AS text_md5 FROM turns")
def stream_dedup_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn is in the stream twice and leaves it once."""
    root = run_folder(spark)
    turns = as_turns(conversation_stream(spark, sf))
    twice = turns.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = stream_dedup(twice).select("memory_id", "text", "created_at")
    (out.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/offsets")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out.schema).parquet(f"{root}/rows").select("memory_id", F.md5("text").alias("text_md5"))


@query("stream_reconcile",
       f"""WITH {Q.DOCS} SELECT memory_id, md5(CASE WHEN toxic = 1 THEN text||' changed' ELSE text END) AS text_md5
       FROM docs WHERE lang <> 'de'""")
def stream_reconcile_all(spark: SparkSession, sf: str) -> DataFrame:
    """A store of the labelled documents follows a snapshot that lacks German ones, holds toxic
    ones changed, and has the rest."""
    root = run_folder(spark)
    store = Store(spark, f"{root}/store", buckets=8)
    docs = W.document_memories(spark, sf).withColumn("chunk_count", F.lit(1)).withColumn(
        "turn_index", F.col("turn_index").cast("bigint"))

    def stored(rows: DataFrame) -> DataFrame:
        return rows.withColumn("etag", content_etag("text", "tags", "updated_at")).select(*MEMORY_COLUMNS)

    def pieces(rows: DataFrame) -> DataFrame:
        return rows.select("memory_id", F.lit(0).alias("chunk_index"), "text", text_sha256("text").alias("text_sha256"),
                           F.lit(None).cast("array<float>").alias("vector"))

    labelled = docs.join(W.load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    store.append("chunks", pieces(labelled))
    store.append("memories", stored(labelled))
    changed = F.when(F.array_contains("tags", "toxic"), F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    landed = stored(docs.where(~F.array_contains("tags", "lang:de")).withColumn("text", changed))
    ticks = conversation_stream(spark, sf).select("memory_id")
    stream_reconcile(ticks, lambda: (landed, pieces(landed)), store, f"{root}/offsets", available_now=True).awaitTermination()
    return store.read("memories").select("memory_id", F.md5("text").alias("text_md5"))
