"""Ordered lines of splittable text files, and counts that run along them.

A file may be cut into many splits. Counts are taken per split and offset by the totals of the
earlier splits of the file, so the order inside a large file costs one small aggregate and no
task ever holds a whole file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from anamnesis.operators.sizing import attach

SPLIT = ["path", "block"]


def read_lines(spark: SparkSession, path: str | Sequence[str], names: str | None = None) -> DataFrame:
    """(path, block, pos, line): `pos` orders the lines of one split, `block` the splits of a file.

    `names` keeps files by a glob on their name.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    raw = reader.text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def running_count(rows: DataFrame, flag: Column, out: str) -> DataFrame:
    """Append how many rows of the file up to and including this one satisfy `flag`."""
    marked = rows.withColumn("_flag", F.coalesce(flag.cast("bigint"), F.lit(0)))
    totals = marked.groupBy(*SPLIT).agg(F.sum("_flag").alias("_total"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*SPLIT, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*SPLIT).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.sum("_flag").over(inside))
    return (attach(local, offsets, SPLIT, computed=True)
            .withColumn(out, F.col("_local") + F.col("_offset"))
            .drop("_flag", "_local", "_offset"))


def plain_path(path: Column | str) -> Column:
    """One spelling of a file URL, whichever source reported it."""
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, "^file:/+", "file:/")


def base_name(path: Column | str, extension: str = "") -> Column:
    name = F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]+)/*$", 1)
    return F.regexp_replace(name, extension, "") if extension else name


def parent_name(path: Column | str) -> Column:
    """Name of the directory that holds the file; file URLs are percent-decoded."""
    raw = F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]+)/[^/]+$", 1)
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
