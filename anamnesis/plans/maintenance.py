"""Whole-table jobs: versions published in one step, re-embedding and dimension audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.operators.changes import all_match
from anamnesis.operators.embedding import Embedder, embed_distinct


class VersionedTable:
    """A table whose new content is staged beside the old one and published by one empty marker
    file, whose creation is a single step.

    Versions stay on disk, so the one before is the backup. Staging may be repeated: an
    unpublished version is completed or overwritten, and readers never see it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def current(self) -> int:
        """Number of the published version, 0 before the first."""
        fs, pattern = self._fs(f"{self.root}/published-*")
        found = fs.globStatus(pattern) or []
        return max((int(status.getPath().getName().rsplit("-", 1)[1]) for status in found), default=0)

    def version_path(self, number: int) -> str:
        return f"{self.root}/v={number:06d}"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.version_path(self.current()))

    def staged(self, number: int | None = None) -> DataFrame | None:
        """Rows already written to the next version by an earlier, unfinished run."""
        path = self.version_path(self.current() + 1 if number is None else number)
        fs, jvm_path = self._fs(path)
        return self.spark.read.parquet(path) if fs.exists(jvm_path) else None

    def stage(self, rows: DataFrame) -> None:
        """Append rows to the next version."""
        rows.write.mode("append").parquet(self.version_path(self.current() + 1))

    def publish(self, expected_rows: int) -> int:
        """Make the staged version current once it holds the expected number of rows."""
        number = self.current() + 1
        staged = self.staged(number)
        found = 0 if staged is None else staged.count()
        if found != expected_rows:
            raise ValueError(f"version {number} holds {found} rows, expected {expected_rows}")
        fs, marker = self._fs(f"{self.root}/published-{number:06d}")
        fs.create(marker, False).close()
        return number


def reembed(chunks: DataFrame, embedder: Embedder, staged: DataFrame | None = None,
            cache: DataFrame | None = None) -> DataFrame:
    """New vectors for unchanged texts, with the model's name. Staged chunks of the same model
    are left out, so a restart goes on; equal dimensions are no obstacle."""
    if staged is not None:
        done = staged.where(F.col("model") == embedder.name).select("memory_id", "chunk_index")
        chunks = chunks.join(done, ["memory_id", "chunk_index"], "left_anti")
    fresh = embed_distinct(chunks.drop("vector", "model"), embedder, cache)
    return fresh.withColumn("model", F.lit(embedder.name))


def dimension_audit(chunks: DataFrame, dimensions: int) -> DataFrame:
    """One row: whether the first vector of every memory has the declared dimension."""
    first = chunks.where(F.col("chunk_index") == 0)
    return all_match(first, F.size("vector") == dimensions)
