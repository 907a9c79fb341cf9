"""Set comparison, merge and conditional change of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.operators.sizing import attach


def first_per_id(rows: DataFrame, order: Column | str, key: str = "memory_id") -> DataFrame:
    """The first row per id in input order, as a partial aggregate: a hot id reduces map-side."""
    others = [c for c in rows.columns if c != key]
    order_column = F.col(order) if isinstance(order, str) else order
    return (rows.groupBy(key).agg(F.min_by(F.struct(*others), order_column).alias("_row"))
            .select(key, "_row.*").select(*rows.columns))


def ingest_anti_join(turns: DataFrame, memories: DataFrame, order: Column | str) -> DataFrame:
    """Turns whose id is neither stored nor seen earlier in the batch."""
    return first_per_id(turns, order).join(memories.select("memory_id"), "memory_id", "left_anti")


def without_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return attach(table, ids.select("memory_id").distinct(), "memory_id", "left_anti", even=True)


def unknown_ids(ids: DataFrame, memories: DataFrame) -> DataFrame:
    return ids.select("memory_id").distinct().join(memories.select("memory_id"), "memory_id", "left_anti")


def delete_memories(ids: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(every table without the ids, the ids that were not there)."""
    return ({name: without_ids(table, ids) for name, table in tables.items()},
            unknown_ids(ids, tables["memories"]))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "memory_id",
                  version: str = "version") -> DataFrame:
    """(key, change) for rows added, removed, or whose version differs in either direction."""
    before = old.select(F.col(key), F.col(version).alias("_old"), F.lit(True).alias("_in_old"))
    after = new.select(F.col(key), F.col(version).alias("_new"), F.lit(True).alias("_in_new"))
    joined = before.join(after, key, "full_outer")
    change = (F.when(F.col("_in_old").isNull(), "added")
              .when(F.col("_in_new").isNull(), "removed")
              .when(~F.col("_old").eqNullSafe(F.col("_new")), "updated"))
    return joined.select(key, change.alias("change")).where(F.col("change").isNotNull())


def sync_summary(diff: DataFrame) -> DataFrame:
    """One row: how many rows were added, updated and removed."""
    return diff.agg(*[F.count_if(F.col("change") == kind).alias(kind)
                      for kind in ("added", "updated", "removed")])


def same_rows(left: DataFrame, right: DataFrame, key: str = "memory_id", version: str = "version") -> DataFrame:
    """One row: whether both hold the same (key, version) set, so a derived table may be reused."""
    return snapshot_diff(left, right, key, version).agg((F.count(F.lit(1)) == 0).alias("same"))


def copy_missing(source: DataFrame, target: DataFrame, key: str = "memory_id") -> DataFrame:
    """Source rows whose key the target does not hold."""
    return source.join(target.select(key), key, "left_anti")


def coverage_check(live: DataFrame, backup: DataFrame, key: str = "memory_id") -> DataFrame:
    """One row: whether live holds every backed-up key, and how many it lacks."""
    return (copy_missing(backup, live, key).agg(F.count(F.lit(1)).alias("missing"))
            .withColumn("covered", F.col("missing") == 0))


def resolve_updates(updates: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applicable, stale) for updates (memory_id, text, tags, etag, update_order).

    The first update of an id that carries the stored etag applies and changes the etag for the
    rest. A refused update changes nothing, so an old etag does not stand in a current one's way.
    """
    stored = memories.select("memory_id", F.col("etag").alias("_stored_etag"))
    known = updates.join(stored, "memory_id", "left")
    current = F.coalesce(F.col("_stored_etag") == F.col("etag"), F.lit(False))
    first = known.where(current).groupBy("memory_id").agg(F.min("update_order").alias("_first"))
    judged = attach(known, first, "memory_id", "left").withColumn(
        "_ok", current & F.coalesce(F.col("update_order") == F.col("_first"), F.lit(False)))
    reason = F.when(F.col("_stored_etag").isNull(), "missing").otherwise("stale")
    applicable = judged.where("_ok").drop("_ok", "_first", "_stored_etag")
    stale = judged.where("NOT _ok").select("memory_id", "update_order", reason.alias("reason"))
    return applicable, stale


def apply_updates(applicable: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """Memories after the updates: null tags keep the set, an array replaces it, [] clears it."""
    change = applicable.select("memory_id", F.col("text").alias("_text"), F.col("tags").alias("_tags"),
                               F.lit(True).alias("_hit"))
    joined = memories.join(change, "memory_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    replaced = {
        "text": F.when(hit, F.col("_text")).otherwise(F.col("text")),
        "tags": F.when(hit, F.coalesce(F.col("_tags"), F.col("tags"))).otherwise(F.col("tags")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in memories.columns])


def link_replies(turns: DataFrame) -> DataFrame:
    """Each reply with `dangling`: its parent was filtered out and stays a plain id."""
    parents = turns.select(F.col("memory_id").alias("parent_id"), F.lit(True).alias("_known"))
    replies = turns.where(F.col("parent_id").isNotNull())
    return (attach(replies, parents, "parent_id", "left")
            .select("memory_id", "parent_id", F.col("_known").isNull().alias("dangling")))


def all_match(rows: DataFrame, predicate: Column) -> DataFrame:
    """One row: whether every row satisfies the predicate (true for an empty table)."""
    return rows.agg(F.coalesce(F.every(F.coalesce(predicate, F.lit(False))), F.lit(True)).alias("holds"))


def concat_tags(first: Column | str, second: Sequence[str]) -> Column:
    """Source tags, then user tags, in order and not deduplicated."""
    column = F.col(first) if isinstance(first, str) else first
    return F.concat(column, F.array(*[F.lit(t) for t in second]).cast("array<string>"))
