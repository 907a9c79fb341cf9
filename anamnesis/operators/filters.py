"""Which rows take part: metadata filters, gates, cut-offs and the reserved tag."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.constants import COLD_QUERY_DISTANCE, RELEVANCE_DISTANCE, RESERVED_TAG
from anamnesis.functions.core import is_blank
from anamnesis.functions.ids import is_valid_id
from anamnesis.functions.times import range_end


@dataclass(frozen=True)
class MetaFilter:
    """All set fields must hold; an empty filter passes everything."""

    conversation_id: str | None = None
    tags: Sequence[str] = field(default_factory=tuple)
    exclude_tags: Sequence[str] = field(default_factory=tuple)
    start: str | None = None
    end: str | None = None

    @property
    def active(self) -> bool:
        return bool(self.conversation_id or self.tags or self.exclude_tags
                    or self.start is not None or self.end is not None)


def any_tag(tags: Sequence[str]) -> Column:
    return F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))


def meta_filter(memories: DataFrame, wanted: MetaFilter | None) -> DataFrame:
    """Rows of `memories` that satisfy every set field; plain predicates that reach the scan."""
    if wanted is None or not wanted.active:
        return memories
    if wanted.conversation_id:
        memories = memories.where(F.col("conversation_id") == wanted.conversation_id)
    if wanted.tags:
        memories = memories.where(any_tag(wanted.tags))
    if wanted.exclude_tags:
        memories = memories.where(~any_tag(wanted.exclude_tags))
    if wanted.start is not None:
        memories = memories.where(F.col("updated_at") >= F.to_timestamp(F.lit(wanted.start)))
    if wanted.end is not None:
        memories = memories.where(F.col("updated_at") <= range_end(wanted.end))
    return memories


def allowed_ids(memories: DataFrame, wanted: MetaFilter | None) -> DataFrame | None:
    """The memory_ids a filter leaves, or None where nothing is filtered."""
    if wanted is None or not wanted.active:
        return None
    return meta_filter(memories, wanted).select("memory_id")


def split_valid_ids(rows: DataFrame, *id_columns: str, optional: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): every id must have the id shape, an optional one may be null."""
    good = F.lit(True)
    for name in id_columns:
        good = good & is_valid_id(name)
    for name in optional:
        good = good & (F.col(name).isNull() | is_valid_id(name))
    return rows.where(good), rows.where(~good)


def require_valid_ids(rows: DataFrame, *id_columns: str, optional: Sequence[str] = ()) -> None:
    """Refuse a whole batch that carries a malformed id."""
    _, bad = split_valid_ids(rows, *id_columns, optional=optional)
    if not bad.isEmpty():
        raise ValueError("batch refused: it carries an invalid id")


def relevant(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("distance") < RELEVANCE_DISTANCE)


def warm_queries(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Queries that have a close enough dense hit, or any lexical hit."""
    near = dense.where((F.col("rank") == 1) & (F.col("distance") < COLD_QUERY_DISTANCE)).select("query_id")
    return near.unionByName(sparse.where(F.col("rank") == 1).select("query_id")).distinct()


def cold_query_gate(hits: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Drop every hit of a query that neither leg can answer."""
    return hits.join(warm_queries(dense, sparse), "query_id", "left_semi")


def carries_reserved(tags: Column | str = "tags") -> Column:
    return F.coalesce(F.array_contains(tags, RESERVED_TAG), F.lit(False))


def reserved_holder(memories: DataFrame) -> DataFrame:
    """One row: the lowest memory_id that carries the reserved tag, or null."""
    return memories.where(carries_reserved()).agg(F.min("memory_id").alias("holder"))


def reserved_tag_rule(rows: DataFrame, memories: DataFrame, kind: str) -> DataFrame:
    """Add `reserved_ok`. Imports never set the tag; a write may only while none holds it (and
    only its first such row); an update may only on the holder, or while none holds it only on
    the memory of the first such row. The rows given are those that would go through otherwise:
    `write_batch` and `update_batch` leave out empty, near-duplicate and stale ones first."""
    holder = reserved_holder(memories).scalar()
    marked = carries_reserved()
    if kind == "ingest":
        ok = ~marked
    elif kind == "write":
        first = rows.where(marked).agg(F.min("input_order")).scalar()
        ok = ~marked | (holder.isNull() & (F.col("input_order") == first))
    elif kind == "update":
        claims = rows.where(marked)
        first = claims.agg(F.min_by("memory_id", F.struct("update_order", "memory_id"))).scalar() \
            if "update_order" in rows.columns else claims.agg(F.min("memory_id")).scalar()
        ok = ~marked | (F.col("memory_id") == F.coalesce(holder, first))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return rows.withColumn("reserved_ok", F.coalesce(ok, F.lit(False)))


def drop_empty(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept, empty): white-space-only texts do not become memories."""
    return rows.where(~is_blank(text)), rows.where(is_blank(text))


def is_abstention(question_id: Column | str = "question_id") -> Column:
    return F.contains(F.col(question_id) if isinstance(question_id, str) else question_id, F.lit("_abs"))


def is_scorable(truth_ids: Column | str) -> Column:
    return F.size(truth_ids) > 0
