"""One listing entry point: filters stack, a query reorders and never narrows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from anamnesis.constants import LIST_K
from anamnesis.functions.core import iso_millis
from anamnesis.operators.embedding import Embedder
from anamnesis.operators.filters import MetaFilter
from anamnesis.operators.listing import list_ranked, memory_texts, recent
from anamnesis.plans.recall import rank_memories
from anamnesis.session import cut_lineage


def list_memories(memories: DataFrame, chunks: DataFrame, wanted: MetaFilter | None = None,
                  queries: DataFrame | None = None, k: int = LIST_K, retriever: str = "hybrid",
                  embedder: Embedder | None = None) -> DataFrame:
    """Rows with full text and ISO times; with queries, one list per query and its `rank`."""
    columns = ["memory_id", "conversation_id", "tags", "created_at", "updated_at"]
    if queries is None:
        picked = recent(memories.select(*columns), k, wanted)
    else:
        ranked = rank_memories(queries, memories, chunks, k, retriever, wanted, embedder)
        places = list_ranked(queries, ranked, memories, k, wanted)
        picked = memories.select(*columns).join(places, "memory_id")
    # At most k rows per list: kept once, so that fetching their texts does not rank again.
    picked = cut_lineage(picked)
    return (picked.join(memory_texts(picked, chunks), "memory_id")
            .withColumn("created_at", iso_millis("created_at")).withColumn("updated_at", iso_millis("updated_at"))
            .drop("part"))


def newest(memories: DataFrame, chunks: DataFrame, k: int = LIST_K) -> DataFrame:
    return list_memories(memories, chunks, None, None, k)


