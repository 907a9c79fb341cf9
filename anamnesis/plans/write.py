"""Import, write, update, delete and reconcile as table-to-table plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.constants import RESERVED_TAG
from anamnesis.functions.chunking import chunk_text
from anamnesis.functions.core import is_blank, is_row, numbered_rows_of
from anamnesis.functions.ids import content_etag, text_sha256
from anamnesis.operators.changes import (
    apply_updates,
    concat_tags,
    first_per_id,
    resolve_updates,
    snapshot_diff,
    sync_summary,
    unknown_ids,
    without_ids,
)
from anamnesis.operators.dedup import near_duplicate_join, nearest_before
from anamnesis.operators.embedding import Embedder, embed_distinct, new_cache_rows, with_vectors
from anamnesis.operators.filters import carries_reserved, require_valid_ids, reserved_holder
from anamnesis.operators.sizing import attach
from anamnesis.session import cut_lineage

MEMORY_COLUMNS = ["memory_id", "conversation_id", "parent_id", "turn_index", "tags", "text", "created_at",
                  "updated_at", "chunk_count", "etag"]


@dataclass(frozen=True)
class Change:
    """What a plan adds to and removes from the store, and what it has to report."""

    memories: DataFrame
    chunks: DataFrame
    gone: DataFrame | None
    report: DataFrame


def split_pieces(rows: DataFrame) -> DataFrame:
    """Add `pieces`: given chunks as they are, a text split when it is too long; blanks dropped."""
    pieces = chunk_text("text")
    if "chunks" in rows.columns:
        pieces = F.coalesce(F.filter("chunks", lambda c: ~is_blank(c)), pieces)
    return rows.withColumn("pieces", pieces)


def chunk_rows(rows: DataFrame) -> DataFrame:
    """(memory_id, chunk_index, text, text_sha256) from rows with `pieces`."""
    return (rows.select("memory_id", numbered_rows_of(F.col("pieces"), "chunk_index", "text"))
            .where(is_row("text")).withColumn("text_sha256", text_sha256("text")))


def memory_rows(rows: DataFrame) -> DataFrame:
    """Complete rows of the memories table from rows with `pieces` and times."""
    columns = {
        "conversation_id": "string", "parent_id": "string", "turn_index": "bigint",
    }
    for name, kind in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    text = F.array_join("pieces", "\n")  # no match may reach over the end of a chunk
    full = rows.select(
        "memory_id", "conversation_id", "parent_id", F.col("turn_index").cast("bigint").alias("turn_index"), "tags",
        text.alias("text"), "created_at", "updated_at", F.size("pieces").alias("chunk_count"))
    return full.withColumn("etag", content_etag("text", "tags", "updated_at")).select(*MEMORY_COLUMNS)


def ingest(turns: DataFrame, memories: DataFrame, now: Column, tags: Sequence[str] = (),
           order: Column | None = None) -> Change:
    """Idempotent import of assembled turns: known and repeated ids are skipped, as are empty texts.

    Imports do no similarity check and never set the reserved tag. A turn without a time takes
    its session's, else `now`; both times of the memory are then equal.
    """
    if RESERVED_TAG in tags:
        raise ValueError(f"imports may not set the tag {RESERVED_TAG}")
    require_valid_ids(turns, "memory_id", "conversation_id", optional=("parent_id",))
    # Resumed sessions repeat ids: every column that tells two copies apart takes part in the order.
    ties = [c for c in ("conversation_id", "parent_id", "source", "path", "text") if c in turns.columns]
    in_order = F.struct("turn_index", "memory_id", *ties) if order is None else order
    fresh = first_per_id(turns, in_order).join(memories.select("memory_id"), "memory_id", "left_anti")
    at = F.coalesce("created_at", "session_at", now) if "session_at" in turns.columns else F.coalesce("created_at", now)
    # Texts are split once, for the report and for both tables; a filter beside the split would split them again.
    split = cut_lineage(split_pieces(fresh).withColumn("created_at", at).drop("text", "chunks"))
    prepared = (split.where(F.size("pieces") > 0).withColumn("updated_at", F.col("created_at"))
                .withColumn("tags", concat_tags("tags", tags)))
    added = prepared.select("conversation_id", F.lit(1).alias("added"), F.lit(0).alias("seen"))
    seen = turns.select("conversation_id", F.lit(0).alias("added"), F.lit(1).alias("seen"))
    stats = added.unionByName(seen).groupBy("conversation_id").agg(
        F.sum("added").alias("added"), (F.sum("seen") - F.sum("added")).alias("skipped"))
    return Change(memory_rows(prepared), chunk_rows(prepared), None, stats)


def ingest_stats(report: DataFrame) -> DataFrame:
    """One row: conversations with new turns, conversations already present, turns added and skipped."""
    return report.agg(F.count_if(F.col("added") > 0).alias("written"),
                      F.count_if(F.col("added") == 0).alias("all_present"),
                      F.coalesce(F.sum("added"), F.lit(0)).alias("added"),
                      F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))


def ingest_preview(turns: DataFrame) -> DataFrame:
    """What a dry run reports: turns per conversation, nothing written."""
    return turns.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("turns"))


def write_batch(rows: DataFrame, memories: DataFrame, chunks: DataFrame, embedder: Embedder, now: Column) -> Change:
    """Admit new memories (memory_id, text or chunks, tags, input_order).

    The report gives each row's outcome: accepted, empty, reserved or duplicate, with the nearest
    memory that was there before it.
    """
    # Texts are kept once, as pieces; vectors by the texts they belong to, and by chunk without text.
    judged = cut_lineage(split_pieces(rows).withColumn("claims", carries_reserved()).drop("text", "chunks"))
    pieces = chunk_rows(judged)
    by_text = cut_lineage(new_cache_rows(pieces, embedder, None).select("text_sha256", "vector"))
    vectors = cut_lineage(with_vectors(pieces, by_text).select("memory_id", "chunk_index", "vector"))
    firsts = cut_lineage(vectors.where("chunk_index = 0").select("memory_id", "vector").join(
        judged.select("memory_id", "input_order", "claims"), "memory_id"))
    held = reserved_holder(memories).first()[0] is not None
    admitted, refused = _admit_with_claims(firsts, chunks, vectors, held)
    reserved = refused.select("memory_id", F.lit(True).alias("refused"))
    early = F.when(F.size("pieces") == 0, "empty").when(F.col("refused"), "reserved")
    marked = judged.join(reserved, "memory_id", "left").withColumn("early", early).drop("refused", "claims")
    outcome = F.coalesce("early", F.when(F.col("accepted"), "accepted").otherwise("duplicate"))
    report = marked.select("memory_id", "early").join(admitted, "memory_id", "left").select(
        "memory_id", outcome.alias("outcome"), "similar_id", "similarity")
    accepted = marked.join(admitted.where("accepted").select("memory_id"), "memory_id", "left_semi").withColumn(
        "created_at", now).withColumn("updated_at", now).withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>")))
    return Change(memory_rows(accepted), with_vectors(chunk_rows(accepted), by_text), None, report)


def _admit_with_claims(firsts: DataFrame, chunks: DataFrame, vectors: DataFrame, held: bool) -> tuple[DataFrame, DataFrame]:
    """(admitted, claimants refused). The reserved tag goes to the first claimant that is no duplicate;
    claimants before it are duplicates, those behind it are refused and stand in nobody's way.

    Until a claimant is accepted, none takes part in admission. So one admission of the other rows
    tells which claimant is the first to be near no accepted row; a second one, with it, is needed only
    where it is near a later row. Two admissions do, whatever the number of claimants.
    """
    plain, claimants = firsts.where(~F.col("claims")), firsts.where("claims")
    admitted = cut_lineage(near_duplicate_join(plain, chunks, vectors))
    if held or claimants.isEmpty():
        return admitted, claimants
    taken = plain.join(admitted.where("accepted"), "memory_id", "left_semi")
    near = nearest_before(claimants, chunks, taken, vectors)
    winner = cut_lineage(claimants.join(near.select("memory_id"), "memory_id", "left_anti")
                         .orderBy("input_order").limit(1))
    first = winner.first()
    if first is None:  # every claimant is a duplicate
        return admitted.unionByName(near.withColumn("accepted", F.lit(False))), claimants.limit(0)
    earlier = F.col("input_order") < F.lit(first.input_order)
    duplicates = near.join(claimants.where(earlier).select("memory_id"), "memory_id", "left_semi")
    behind = plain.where(F.col("input_order") > F.lit(first.input_order))
    if not nearest_before(behind, None, winner, vectors).isEmpty():
        with_winner = firsts.where(~F.col("claims") | (F.col("memory_id") == F.lit(first.memory_id)))
        admitted = near_duplicate_join(with_winner, chunks, vectors)
    else:
        admitted = admitted.unionByName(winner.select("memory_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias(
            "similar_id"), F.lit(None).cast("double").alias("similarity")))
    refused = claimants.where(F.col("input_order") > F.lit(first.input_order))
    return admitted.unionByName(duplicates.withColumn("accepted", F.lit(False))), refused


def update_batch(updates: DataFrame, memories: DataFrame, now: Column, embedder: Embedder | None = None) -> Change:
    """Conditional updates (memory_id, text, tags, etag, update_order), as if taken one after another.

    An update is refused, in this order of reasons: `reserved` where another memory holds the
    reserved tag that it claims, `missing`, `empty`, or `stale` where its etag is no longer that of the
    memory. Creation time, conversation and parent stay; text is split again and embedded again.
    """
    judged = cut_lineage(_judge_claims(updates, memories))
    sound = ~is_blank("text")
    applicable, stale = resolve_updates(judged.where(F.col("_allowed") & sound).drop("_allowed", "_stored", "_current"), memories)
    reason = F.when(~F.col("_allowed"), "reserved").when(F.col("_stored").isNull(), "missing").otherwise("empty")
    refused = judged.where(~F.col("_allowed") | ~sound).select("memory_id", "update_order", reason.alias("reason"))
    touched = attach(memories, applicable.select("memory_id"), "memory_id", "left_semi", even=True)
    changed = cut_lineage(split_pieces(apply_updates(applicable, touched, now)).drop("text", "chunks"))
    pieces = chunk_rows(changed)
    return Change(memory_rows(changed), pieces if embedder is None else embed_distinct(pieces, embedder),
                  applicable.select("memory_id"), stale.unionByName(refused))


def _judge_claims(updates: DataFrame, memories: DataFrame) -> DataFrame:
    """Updates with `_allowed`: false where an update claims the reserved tag while another memory
    holds it. The holder is the lowest id that carries the tag at that moment.

    Stored carriers leave the tag as their updates come up (`_release_spans`). While one is left, a claim
    goes through on the lowest of them only. From then on the first claim that applies takes the tag
    for the rest of the batch, as its memory's etag has changed.
    """
    stored = memories.select("memory_id", F.col("etag").alias("_stored"), carries_reserved().alias("_carrier"))
    known = cut_lineage(updates.join(stored, "memory_id", "left").withColumn(
        "_current", F.coalesce(F.col("_stored") == F.col("etag"), F.lit(False))))
    claims, at = carries_reserved(), F.struct(F.col("update_order").cast("bigint").alias("update_order"), "memory_id")
    effective = F.col("_current") & ~is_blank("text")
    spans, free_from = _release_spans(known.where(F.col("_carrier") & effective), memories)
    allowed = ~claims
    for holder, since, until in spans:  # carriers that are lowest at some moment: one, where the rule was kept
        allowed = allowed | ((F.col("memory_id") == F.lit(holder)) & (at > _moment(since)) & (at <= _moment(until)))
    if free_from is not None:
        free = at > _moment(free_from)
        # A memory whose own plain update comes first has another etag when its claim comes up.
        plain = known.where(effective & ~claims).groupBy("memory_id").agg(F.min("update_order").alias("_plain"))
        could = known.where(effective & claims & free & ~F.coalesce("_carrier", F.lit(False))).join(plain, "memory_id", "left") \
            .where(F.col("_plain").isNull() | (F.col("update_order") < F.col("_plain")))
        winner = could.agg(F.min(at).alias("at")).first()["at"]
        if winner is None:
            allowed = allowed | free
        else:
            taken = _moment((winner.update_order, winner.memory_id))
            allowed = allowed | (free & (at <= taken)) | ((at > taken) & (F.col("memory_id") == F.lit(winner.memory_id)))
    return known.withColumn("_allowed", F.coalesce(allowed, F.lit(False))).drop("_carrier")


_BEFORE_ALL, _NEVER = (-(1 << 62), ""), ((1 << 62), "")


def _moment(at: tuple[int, str]) -> Column:
    return F.struct(F.lit(at[0]).cast("bigint").alias("update_order"), F.lit(at[1]).alias("memory_id"))


def _release_spans(effective: DataFrame, memories: DataFrame) -> tuple[list[tuple[str, tuple, tuple]], tuple | None]:
    """(id, since, until) of the stored carriers from the lowest on, while each is the lowest that is
    left; and the moment from which none is left, or None if one keeps the tag.

    `effective` holds the carriers' updates with the current etag and a text. They are read in order
    of id, one carrier at a time, up to the first that keeps the tag; a store in which the rule was kept
    has one carrier.
    """
    lets_go = F.col("tags").isNotNull() & ~carries_reserved()
    keeper = memories.where(carries_reserved()).select("memory_id") \
        .join(effective.where(lets_go).select("memory_id").distinct(), "memory_id", "left_anti").agg(F.min("memory_id")).first()[0]
    rows = effective if keeper is None else effective.where(F.col("memory_id") < F.lit(keeper))
    ordered = rows.select("memory_id", "update_order", carries_reserved().alias("claims"), lets_go.alias("lets_go")) \
        .orderBy("memory_id", "update_order")
    spans, since = [], _BEFORE_ALL
    for holder, own in groupby(ordered.toLocalIterator(), key=lambda r: r.memory_id):
        until = _NEVER
        for update in own:
            at = (update.update_order, holder)
            if not update.claims or at > since:  # a claim is refused while a lower carrier is left
                until = at if update.lets_go else _NEVER
                break
        spans.append((holder, since, until))
        since = max(since, until)
        if until == _NEVER:
            return spans, None
    if keeper is not None:
        return [*spans, (keeper, since, _NEVER)], None
    return spans, since


def delete_batch(ids: DataFrame, memories: DataFrame, chunks: DataFrame) -> Change:
    """Remove memories with everything derived from them; the report lists unknown ids."""
    known = ids.select("memory_id").distinct().join(memories.select("memory_id"), "memory_id", "left_semi")
    return Change(memories.limit(0), chunks.limit(0), known, unknown_ids(ids, memories))


def reconcile(snapshot_memories: DataFrame, snapshot_chunks: DataFrame, memories: DataFrame,
              version: str = "etag") -> Change:
    """Follow a landed snapshot: rows that are new or whose version differs come in, absent ones go."""
    diff = snapshot_diff(memories, snapshot_memories, "memory_id", version)
    incoming = diff.where(F.col("change") != "removed").select("memory_id")
    outgoing = diff.where(F.col("change") != "added").select("memory_id")
    return Change(snapshot_memories.join(incoming, "memory_id", "left_semi"),
                  attach(snapshot_chunks, incoming, "memory_id", "left_semi", even=True), outgoing, sync_summary(diff))


def applied(table: DataFrame, change_rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """A table after a change."""
    kept = table if gone is None else without_ids(table, gone)
    return kept.unionByName(change_rows.select(*table.columns))
