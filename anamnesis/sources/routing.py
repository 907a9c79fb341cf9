"""Which reader a file belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.text import strip_marks
from anamnesis.operators.sizing import attach
from anamnesis.sources.lines import base_name, plain_path, read_lines
from anamnesis.sources.transcripts import (
    AGENT_JSONL,
    BRACKETED_LINE,
    CHANNEL_EXPORT,
    CHAT_TEXT,
    CHAT_TREE,
    DASHED_LINE,
    KV_SESSIONS,
    MESSENGER_EXPORT,
    PARTS_SESSIONS,
    SESSION_JSONL,
)

SNIFFED_LINES = 10


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of files at depth 0 and 1; names starting with a dot are passed over.

    Only the listing is read: file contents are pruned away.
    """
    base = root.rstrip("/")
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
             .select("path", "length"))
    inside = F.regexp_replace(F.expr("substring_index(path, ':', -1)"), "^/+", "/")
    tail = F.substring(inside, len(base.split(":", 1)[-1].rstrip("/")) + 2, F.lit(4096))
    parts = F.split(tail, "/")
    shallow = (F.size(parts) <= 2) & ~F.exists(parts, lambda p: p.startswith("."))
    return found.where(shallow)


def hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of files whose names start with an underscore. Spark's listing passes over them, so
    no reader sees their content; an import reports them. Only names are read."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    found = []
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().startswith("_"):
            found.append((path.toString(),))
    return spark.createDataFrame(found, "path string")


def sniff_chat_text(lines: DataFrame) -> DataFrame:
    """(path, chat_text): whether one of a file's first lines opens a chat message.

    The first lines lie in the first split, where consecutive lines have consecutive positions.
    """
    head = lines.where("block = 0")
    first = head.groupBy("path").agg(F.min("pos").alias("_first"))
    line = strip_marks("line")
    opens = line.rlike(BRACKETED_LINE) | line.rlike(DASHED_LINE)
    return (attach(head, first, "path").where(F.col("pos") - F.col("_first") < SNIFFED_LINES)
            .groupBy("path").agg(F.coalesce(F.bool_or(opens), F.lit(False)).alias("chat_text")))


def route_files(files: DataFrame, sniffed: DataFrame | None = None) -> DataFrame:
    """(path, source): the first rule that claims the file, null when none does.

    `sniffed` (path, chat_text) carries the content rule for `.txt` files.
    """
    name = F.lower(base_name("path"))
    path = F.col("path")
    if sniffed is not None:
        files = attach(files, sniffed, "path", "left")
        chat_text = F.coalesce("chat_text", F.lit(False))
    else:
        chat_text = F.lit(False)
    jsonl = name.endswith(".jsonl")
    source = (
        F.when(name == "conversations.json", CHAT_TREE)
        .when(jsonl & F.contains(path, F.lit("/.claude/projects/")), SESSION_JSONL)
        .when(name == "state.vscdb", KV_SESSIONS)
        .when(jsonl & ~name.endswith(".trajectory.jsonl") & F.contains(path, F.lit("/agents/"))
              & F.contains(path, F.lit("/sessions/")), AGENT_JSONL)
        .when(name == "opencode.db", PARTS_SESSIONS)
        .when(name.rlike(r"^\d{4}-\d{2}-\d{2}\.json$"), CHANNEL_EXPORT)
        .when(name == "result.json", MESSENGER_EXPORT)
        .when(name.endswith(".txt") & chat_text, CHAT_TEXT)
    )
    return files.select("path", source.alias("source"))


def route_tree(spark: SparkSession, root: str) -> DataFrame:
    """List a tree and route it, sniffing the first lines of its `.txt` files."""
    sniffed = sniff_chat_text(read_lines(spark, root, "*.[tT][xX][tT]"))
    return route_files(list_files(spark, root).withColumn("path", plain_path("path")),
                       sniffed.withColumn("path", plain_path("path")))
