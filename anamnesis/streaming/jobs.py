"""Streams share the batch functions: each micro-batch is one batch plan against the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from anamnesis.constants import RECONCILE_MINUTES
from anamnesis.operators.embedding import Embedder, embed_distinct, new_cache_rows
from anamnesis.plans.write import Change, ingest, reconcile
from anamnesis.sources.transcripts import assemble_sessions
from anamnesis.store import Store

Parse = Callable[[DataFrame], DataFrame]


def line_stream(spark: SparkSession, landing: str, names: str = "*.jsonl", max_files: int = 1000) -> DataFrame:
    """Lines of transcript files as they land, in the shape `read_lines` gives."""
    raw = (spark.readStream.format("text").schema("value string").option("lineSep", "\n")
           .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True)
           .option("pathGlobFilter", names).load(landing))
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "\r$", "").alias("line"))


def _positioned(lines: DataFrame) -> DataFrame:
    return lines.withColumn("pos", F.monotonically_increasing_id())


def ingest_turns(store: Store, turns: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """One idempotent import into the store; returns turns added and skipped per conversation.

    A replayed batch finds its ids stored and adds nothing.
    """
    change = ingest(assemble_sessions(turns), store.read("memories"), F.current_timestamp())
    if embedder is not None:
        cache = store.cache()
        store.append_cache(new_cache_rows(change.chunks, embedder, cache))
        change = Change(change.memories, embed_distinct(change.chunks, embedder, store.cache()), None, change.report)
    return store.apply(change)


def stream_ingest(lines: DataFrame, parse: Parse, store: Store, checkpoint: str,
                  embedder: Embedder | None = None) -> StreamingQuery:
    """Import transcripts as they grow. A re-sent file adds only its new turns."""
    def one(batch: DataFrame, batch_id: int) -> None:
        ingest_turns(store, parse(_positioned(batch)), embedder)

    return (lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_table_ingest(turns: DataFrame, store: Store, checkpoint: str,
                        embedder: Embedder | None = None) -> StreamingQuery:
    """The same for a stream that already has the turns schema."""
    def one(batch: DataFrame, batch_id: int) -> None:
        ingest_turns(store, batch, embedder)

    return (turns.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_dedup(rows: DataFrame, key: str = "memory_id") -> DataFrame:
    """The first row of every id, over the whole stream. Imported history is always late, so no
    watermark may drop it; the state holds one entry per id."""
    return rows.dropDuplicates([key])


def stream_reconcile(ticks: DataFrame, snapshot: Callable[[], tuple[DataFrame, DataFrame]], store: Store,
                     checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """At every trigger, follow the landed snapshot: new, changed and removed rows."""
    def one(_: DataFrame, batch_id: int) -> None:
        memories, chunks = snapshot()
        store.apply(reconcile(memories, chunks, store.read("memories")))

    writer = ticks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=f"{RECONCILE_MINUTES} minutes"))
    return writer.start()
