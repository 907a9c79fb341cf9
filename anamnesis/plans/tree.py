"""Import of a folder of transcripts in one call: list, route, parse, union, ingest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.plans.write import Change, ingest, ingest_preview
from anamnesis.session import cut_lineage
from anamnesis.sources.lines import read_lines
from anamnesis.sources.routing import hidden_files, route_tree
from anamnesis.sources.transcripts import AGENT_JSONL, FILE_READERS, SESSION_JSONL, assemble_sessions, line_rejects


@dataclass(frozen=True)
class TreeImport:
    """turns: what was parsed, none where `change` is None (dry run). files: (path, source, status).
    rejects: (path, line_no, content) of lines that could not be read."""

    turns: DataFrame
    change: Change | None
    preview: DataFrame
    files: DataFrame
    rejects: DataFrame


def import_tree(spark: SparkSession, root: str, memories: DataFrame, now: Column, tags: Sequence[str] = (),
                dry_run: bool = False) -> TreeImport:
    """Parse every file a reader claims and import the turns.

    A file's status is `imported`, `unclaimed` (no reader), or `hidden` (a name that Spark's
    readers pass over, so that its content is not read). Nothing is left out in silence.
    """
    routed = cut_lineage(route_tree(spark, root))
    parts, rejects = [], []
    for source, reader in FILE_READERS.items():
        paths = [r.path for r in routed.where(F.col("source") == source).select("path").toLocalIterator()]
        if not paths:
            continue
        parts.append(reader(spark, paths))
        if source in (SESSION_JSONL, AGENT_JSONL):
            rejects.append(line_rejects(read_lines(spark, paths)))
    files = routed.select("path", "source", F.when(F.col("source").isNull(), "unclaimed").otherwise("imported").alias("status"))
    files = files.unionByName(hidden_files(spark, root).select("path", F.lit(None).cast("string").alias("source"),
                                                               F.lit("hidden").alias("status")))
    nothing = spark.createDataFrame([], "path string, line_no bigint, content string")
    bad = reduce(DataFrame.unionByName, rejects) if rejects else nothing
    if not parts:
        empty = spark.createDataFrame([], "conversation_id string, turns bigint")
        return TreeImport(memories.limit(0), None, empty, files, bad)
    turns = cut_lineage(assemble_sessions(reduce(DataFrame.unionByName, parts)))  # parsed once for all that follows
    change = None if dry_run else ingest(turns, memories, now, tags)
    return TreeImport(turns, change, ingest_preview(turns), files, bad)
