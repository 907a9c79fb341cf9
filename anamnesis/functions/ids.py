"""Deterministic ids and chunk keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.constants import ID_PATTERN
from anamnesis.functions.core import as_column, bind, iso_millis


def is_valid_id(value: Column | str) -> Column:
    """UUID shape of any version; null is not an id."""
    return F.coalesce(as_column(value).rlike(ID_PATTERN), F.lit(False))


def to_uuid(seed: Column | str) -> Column:
    """Name-based id: SHA-256 of the seed, version nibble 5, RFC 4122 variant nibble. Null stays null."""

    def layout(digest: Column) -> Column:
        # The variant nibble keeps its two low bits under a fixed high pair: 8, 9, a or b.
        variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat_ws(
            "-",
            F.substring(digest, 1, 8),
            F.substring(digest, 9, 4),
            F.concat(F.lit("5"), F.substring(digest, 14, 3)),
            F.concat(variant, F.substring(digest, 18, 3)),
            F.substring(digest, 21, 12),
        )

    value = as_column(seed)
    return F.when(value.isNotNull(), bind(F.sha2(value, 256), layout))


def chunk_key(memory_id: Column | str, chunk_index: Column | str) -> Column:
    return F.concat(as_column(memory_id), F.lit("#"), as_column(chunk_index).cast("string"))


def chunk_key_memory(key: Column | str) -> Column:
    """Everything before the last `#`; a key without one is a memory id itself."""
    return F.regexp_replace(as_column(key), r"(?s)#[^#]*$", "")


def chunk_key_index(key: Column | str) -> Column:
    tail = F.regexp_extract(as_column(key), r"#([^#]*)$", 1)
    return F.coalesce(tail.try_cast("int"), F.lit(0))


def text_sha256(text: Column | str) -> Column:
    return F.sha2(as_column(text), 256)


def content_etag(text: Column | str, tags: Column | str, updated_at: Column | str) -> Column:
    """Version token of a memory: MD5 over its text, tags and time."""
    parts = (as_column(text), F.array_join(as_column(tags), ","), iso_millis(updated_at))
    return F.md5(F.concat_ws("|", *parts))
