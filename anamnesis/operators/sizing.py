"""Joins against a side whose size is measured first.

A side is broadcast only after its rows and bytes were counted. A larger side is joined by a
shuffle in which a key with very many rows is spread over several salts, so that it never becomes
one task; other keys are neither salted nor copied.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anamnesis.session import cut_lineage, shuffles_dropped

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
#: Rows of one key that one task should hold.
HEAVY_ROWS = 1_000_000


def value_bytes(column: Column, data_type: T.DataType) -> Column:
    """Approximate in-memory size of a value, from its type and length."""
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(data_type, T.ArrayType):
        inner = data_type.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            summed = F.aggregate(column, F.lit(0).cast("bigint"),
                                 lambda s, x: s + value_bytes(x, inner).cast("bigint"))
            return F.coalesce(summed, F.lit(0)) + 24
        return F.coalesce(F.greatest(F.size(column), F.lit(0)) * 8, F.lit(0)) + 24
    if isinstance(data_type, T.StructType):
        total = F.lit(16)
        for field in data_type.fields:
            total = total + value_bytes(column.getField(field.name), field.dataType)
        return total
    return F.lit(16)


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) by a partial aggregate over the whole side."""
    size = F.lit(0)
    for field in df.schema.fields:
        size = size + value_bytes(F.col(f"`{field.name}`"), field.dataType)
    with shuffles_dropped(df.sparkSession):
        rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    return rows, total


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    rows, total = measure(df)
    return rows <= max_rows and total <= max_bytes


def salt_of(columns: Sequence[str | Column], salts: int | Column) -> Column:
    """A salt taken from row content, so that a re-run task makes the same choice."""
    return F.pmod(F.xxhash64(*columns), salts if isinstance(salts, Column) else F.lit(salts)).cast("int")


def frequent_keys(left: DataFrame, on: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(keys, _salts) of the keys with more than `heavy_rows` rows, each with the salts its size
    needs. There are at most rows / heavy_rows of them; the counts are partial aggregates."""
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy_rows)
    return counts.select(*on, F.ceil(F.col("_n") / heavy_rows).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Shuffle join whose frequent left keys are spread over as many partitions as their size needs.

    Only the right rows of these keys are copied; all others are joined as they are.
    """
    heavy = cut_lineage(frequent_keys(left, on, heavy_rows))
    if heavy.isEmpty():
        return left.join(right, list(on), how)
    keyed = [c for c in left.columns if not isinstance(left.schema[c].dataType, (T.MapType, T.VariantType))]
    small = F.broadcast(heavy) if fits_broadcast(heavy) else heavy
    spread = salt_of([F.col(f"`{c}`") for c in keyed], F.coalesce("_salts", F.lit(1)))
    salted = left.join(small, list(on), "left").withColumn("_salt", spread).drop("_salts")
    copies = right.join(small, list(on), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def attach(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner",
           max_bytes: int = BROADCAST_MAX_BYTES, computed: bool = False, even: bool = False) -> DataFrame:
    """Join `right` onto a possibly skewed `left`: broadcast if measured small, else salted.

    `computed` marks a right side that is the small result of a heavy plan. It is materialised,
    so that measuring it and joining it do not run that plan twice. `even` says that no key
    can hold many rows on the left, as with the chunks of a memory: a plain shuffle join then
    does, without copies of the right side.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if computed:
        right = cut_lineage(right)
    if fits_broadcast(right, max_bytes=max_bytes):
        return left.join(F.broadcast(right), keys, how)
    return left.join(right, keys, how) if even else salted_join(left, right, keys, how)


def without_known(rows: DataFrame, ids: DataFrame, key: str = "memory_id", max_rows: int = BROADCAST_MAX_ROWS,
                  max_bytes: int = BROADCAST_MAX_BYTES, most_blocks: int = 16) -> DataFrame:
    """Wide rows whose key is not among `ids`, without a move of the rows: ids are dealt into blocks that can be
    broadcast, and each block is met by the rows of its share of keys. Past `most_blocks` scans it is a shuffle."""
    count, size = measure(ids)
    blocks = max(1, math.ceil(count / max_rows), math.ceil(size / max_bytes))
    if blocks == 1:
        return rows.join(F.broadcast(ids), key, "left_anti")
    if blocks > most_blocks:
        return rows.join(ids.hint("shuffle_hash"), key, "left_anti")
    parts = [rows.where(salt_of([key], blocks) == block).join(
        F.broadcast(ids.where(salt_of([key], blocks) == block)), key, "left_anti") for block in range(blocks)]
    return reduce(DataFrame.unionByName, parts)
