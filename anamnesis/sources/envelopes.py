"""Encrypted rows: writing memories as envelopes, and reading them back with every check."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.blocks import variant_list, variant_string
from anamnesis.functions.core import is_row, iso_millis, numbered_rows_of
from anamnesis.functions.crypto import decrypt, encrypt
from anamnesis.functions.times import from_iso
from anamnesis.operators.sizing import without_known
from anamnesis.sources.lines import base_name

ENVELOPE = ("memory_id string, chunks struct<enc: string, iv: string, tag: string>, "
            "meta struct<enc: string, iv: string, tag: string>")


@dataclass(frozen=True)
class MetaNames:
    """Field names inside the decrypted metadata, for stores that use other ones."""

    conversation: str = "conversation_id"
    parent: str = "parent_id"


def write_envelopes(memories: DataFrame, chunks: DataFrame, key: bytes, names: MetaNames = MetaNames()) -> DataFrame:
    """(memory_id, chunks, meta): both payloads encrypted under their own authenticated data."""
    listed = chunks.groupBy("memory_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "text", "vector"))).alias("c"))
    payload = F.to_json(F.transform("c", lambda c: F.struct(c["text"].alias("text"), c["vector"].alias("vector"))))
    meta = F.to_json(F.struct(
        iso_millis("created_at").alias("created_at"), iso_millis("updated_at").alias("updated_at"),
        F.col("conversation_id").alias(names.conversation), F.col("parent_id").alias(names.parent), "tags"))
    # The short rows are hashed, so that the payloads are not sorted.
    return listed.join(memories.drop("text").hint("shuffle_hash"), "memory_id").select(
        "memory_id", encrypt(payload, key, "chunks", "memory_id").alias("chunks"),
        encrypt(meta, key, "meta", "memory_id").alias("meta"))


def envelope_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One JSON file per memory, named by its id: (memory_id, claimed_id, chunks, meta, broken)."""
    paths = [path] if isinstance(path, str) else list(path)
    payload = "struct<enc: string, iv: string, tag: string>"
    rows = (spark.read.option("multiLine", True).option("recursiveFileLookup", True)
            .schema(f"id string, chunks {payload}, meta {payload}, _corrupt_record string").json(paths))
    return rows.select(base_name(F.col("_metadata.file_path"), r"\.[^.]*$").alias("memory_id"),
                       F.col("id").alias("claimed_id"), "chunks", "meta",
                       F.col("_corrupt_record").isNotNull().alias("broken"))


def _opened(envelopes: DataFrame, key: bytes) -> DataFrame:
    """Envelopes with both plain texts and the reason a row is refused, null for a good row."""
    if "claimed_id" not in envelopes.columns:
        envelopes = envelopes.withColumn("claimed_id", F.col("memory_id")).withColumn("broken", F.lit(False))
    plain = envelopes.withColumn("chunks_text", decrypt("chunks", key, "chunks", "memory_id")).withColumn(
        "meta_text", decrypt("meta", key, "meta", "memory_id"))
    parsed = plain.withColumn("c", F.try_parse_json("chunks_text")).withColumn("m", F.try_parse_json("meta_text"))
    listed = variant_list(F.col("c"))
    typed = F.forall(listed, lambda c: variant_string(c, "$.text").isNotNull()
                     & variant_list(c, "$.vector").isNotNull())
    timed = (variant_string(F.col("m"), "$.created_at").isNotNull()
             & variant_string(F.col("m"), "$.updated_at").isNotNull())
    reason = (
        F.when(F.col("broken"), "not-json")
        .when(F.col("claimed_id").isNull() | (F.col("claimed_id") != F.col("memory_id")), "id-mismatch")
        .when(F.col("chunks").isNull(), "chunks-missing")
        .when(F.col("meta").isNull(), "meta-missing")
        .when(F.col("chunks_text").isNull(), "chunks-authentication")
        .when(F.col("meta_text").isNull(), "meta-authentication")
        .when(F.coalesce(F.size(listed), F.lit(0)) < 1, "chunks-empty")
        .when(~typed, "chunk-without-text-or-vector")
        .when(~timed, "meta-without-times")
        .when(variant_list(F.col("m"), "$.tags").isNull(), "meta-without-tags")
    )
    return parsed.withColumn("reason", reason)


def read_envelopes(envelopes: DataFrame, key: bytes,
                   names: MetaNames = MetaNames()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, chunks, rejects). A bad row is passed over with its reason."""
    opened = _opened(envelopes, key)
    good = opened.where(F.col("reason").isNull())
    m = F.col("m")

    def field(name: str) -> Column:
        return variant_string(m, f"$.{name}")

    tags = F.filter(F.transform(variant_list(m, "$.tags"), lambda t: variant_string(t)), lambda t: t.isNotNull())
    listed = F.from_json("chunks_text", "array<struct<text: string, vector: array<float>>>")
    memories = good.select(
        "memory_id", field(names.conversation).alias("conversation_id"), field(names.parent).alias("parent_id"),
        tags.alias("tags"), from_iso(field("created_at")).alias("created_at"),
        from_iso(field("updated_at")).alias("updated_at"), F.size(listed).alias("chunk_count"))
    chunks = good.select("memory_id", numbered_rows_of(listed, "chunk_index", "c")).where(is_row("c")).select(
        "memory_id", "chunk_index", "c.text", "c.vector")
    return memories, chunks, opened.where(F.col("reason").isNotNull()).select("memory_id", "reason")


def integrity_audit(envelopes: DataFrame, key: bytes) -> DataFrame:
    """(reason, rows): `ok`, the refusals, and `wrong-key` in place of authentication failures
    when not a single row opens under the key."""
    counted = (_opened(envelopes, key).select(F.coalesce("reason", F.lit("ok")).alias("reason"))
               .groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))
    opens = counted.where(~F.col("reason").isin("chunks-authentication", "not-json", "id-mismatch", "chunks-missing",
                                                "meta-missing")).agg(F.count(F.lit(1)) > 0).scalar()
    wrong = ~opens & (F.col("reason") == "chunks-authentication")
    return counted.select(F.when(wrong, "wrong-key").otherwise(F.col("reason")).alias("reason"), "rows")


def rotate_key(envelopes: DataFrame, old_key: bytes, new_key: bytes, staged: DataFrame | None = None) -> DataFrame:
    """Envelopes under the new key, each payload with a fresh nonce.

    Rows already staged are left out, so a restart goes on where it stopped. A row that does not
    open under the old key stops the job.
    """
    if staged is not None:
        envelopes = without_known(envelopes, staged.select("memory_id"))

    def again(name: str) -> Column:
        plain = decrypt(name, old_key, name, "memory_id")
        failed = F.raise_error(F.concat(F.lit(f"cannot decrypt {name} of "), F.col("memory_id"))).cast("string")
        return encrypt(F.coalesce(plain, failed), new_key, name, "memory_id")

    return envelopes.select("memory_id", again("chunks").alias("chunks"), again("meta").alias("meta"))
