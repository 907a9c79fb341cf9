"""Semantic and hybrid recall for a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.constants import RECALL_K
from anamnesis.operators.bm25 import bm25_join
from anamnesis.operators.embedding import Embedder, embed_column
from anamnesis.operators.filters import MetaFilter, allowed_ids, cold_query_gate, relevant
from anamnesis.operators.fusion import best_memories, fetch_depth, leg_depth, recall_rows, rrf_fuse
from anamnesis.operators.knn import knn_join
from anamnesis.operators.sizing import fits_broadcast
from anamnesis.session import cut_lineage
from anamnesis.stored_index import StoredIndex


def with_query_vectors(queries: DataFrame, embedder: Embedder | None) -> DataFrame:
    """Queries that carry a vector keep it; otherwise their text is embedded, once."""
    if "query_vector" in queries.columns:
        return queries
    if embedder is None:
        raise ValueError("queries without query_vector need an embedder")
    return cut_lineage(embed_column(queries, embedder, "query_text", "query_vector"))


def semantic_hits(queries: DataFrame, chunks: DataFrame, depth: int, allowed: DataFrame | None,
                  index: StoredIndex | None = None) -> DataFrame:
    """Ranked dense hits."""
    return knn_join(queries, chunks, depth, allowed)


def hybrid_hits(queries: DataFrame, chunks: DataFrame, depth: int, allowed: DataFrame | None,
                index: StoredIndex | None = None) -> DataFrame:
    """Dense and lexical legs fused by reciprocal rank, behind the cold-query gate.

    With the store's `index` the lexical leg reads the lists of the asked terms instead of all texts. Fusion and gate both read the legs, which hold at most queries x depth rows each: they are
    materialised so that either leg scans the corpus once.
    """
    depth_per_leg = leg_depth(depth)
    dense = cut_lineage(knn_join(queries, chunks, depth_per_leg, allowed))
    lexical = bm25_join(queries, chunks, depth_per_leg, allowed) if index is None \
        else index.bm25(queries, depth_per_leg, allowed)
    sparse = cut_lineage(lexical)
    return cold_query_gate(rrf_fuse(depth, dense, sparse), dense, sparse)


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {"semantic": semantic_hits, "hybrid": hybrid_hits}


def rank_memories(queries: DataFrame, memories: DataFrame, chunks: DataFrame, k: int, retriever: str,
                  wanted: MetaFilter | None = None, embedder: Embedder | None = None,
                  index: StoredIndex | None = None) -> DataFrame:
    """Relevant memories per query: (query_id, memory_id, chunk_index, distance, rank)."""
    asked = with_query_vectors(queries, embedder)
    hits = RETRIEVERS[retriever](asked, chunks, fetch_depth(k), allowed_ids(memories, wanted), index)
    return best_memories(relevant(hits), k)


def recall(queries: DataFrame, memories: DataFrame, chunks: DataFrame, k: int = RECALL_K,
           retriever: str = "hybrid", wanted: MetaFilter | None = None,
           embedder: Embedder | None = None, index: StoredIndex | None = None) -> DataFrame:
    """The `k` best memories of each query with their best chunk's text."""
    ranked = rank_memories(queries, memories, chunks, k, retriever, wanted, embedder, index)
    bounded = fits_broadcast(queries.select(F.col("query_id")), max_rows=max(1, 1_000_000 // max(k, 1)))
    return recall_rows(ranked, chunks, memories, bounded)


def recall_semantic(queries: DataFrame, memories: DataFrame, chunks: DataFrame, k: int = RECALL_K,
                    wanted: MetaFilter | None = None, embedder: Embedder | None = None) -> DataFrame:
    return recall(queries, memories, chunks, k, "semantic", wanted, embedder)


def recall_hybrid(queries: DataFrame, memories: DataFrame, chunks: DataFrame, k: int = RECALL_K,
                  wanted: MetaFilter | None = None, embedder: Embedder | None = None,
                  index: StoredIndex | None = None) -> DataFrame:
    return recall(queries, memories, chunks, k, "hybrid", wanted, embedder, index)
