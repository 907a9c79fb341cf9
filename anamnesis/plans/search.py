"""Text search for a table of patterns: status and totals, and capped snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.constants import SNIPPETS_PER_MEMORY, SNIPPETS_PER_PATTERN, TRIGRAM_SIZE
from anamnesis.operators.filters import MetaFilter, meta_filter
from anamnesis.operators.search import (
    Pattern,
    classify,
    find_hits,
    pattern_blocks,
    search_snippets,
    search_totals,
    trigram_index,
    trigram_join,
)
from anamnesis.session import cut_lineage
from anamnesis.stored_index import StoredIndex

SEARCHERS = ("scan", "trigram", "none")
SUMMARY_SCHEMA = "pattern_id string, early string"
HITS_SCHEMA = "pattern_id string, memory_id string, updated_at timestamp, matches bigint"


def search(patterns: DataFrame, memories: DataFrame, wanted: MetaFilter | None = None,
           searcher: str = "scan", index: StoredIndex | DataFrame | None = None, per_memory: int = SNIPPETS_PER_MEMORY,
           per_pattern: int = SNIPPETS_PER_PATTERN, with_snippets: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(summary, snippets), the latter None and not worked out unless `with_snippets`.

    Patterns are answered in blocks (`pattern_blocks`). `scan` reads every text once for a block. `trigram` first narrows literals through
    the trigram index and then verifies, with the same answer; regular expressions and short
    literals are scanned. `index` is that of the store, or a table (trigram, memory_id). `none` disables search. Counts are of all matches; snippets are the first
    `per_memory` of a memory and `per_pattern` of a pattern.
    """
    if searcher not in SEARCHERS:
        raise ValueError(f"unknown searcher {searcher!r}")
    texts = meta_filter(memories, wanted)
    filtered_out = wanted is not None and wanted.active and texts.isEmpty()
    summaries, snippets = [], []
    for requests in pattern_blocks(patterns):
        summary, hits, runnable = _search_block(requests, texts, filtered_out, searcher, index)
        summaries.append(summary)
        if with_snippets:
            snippets.append(search_snippets(hits, texts, runnable, per_memory, per_pattern))
    return reduce(DataFrame.unionByName, summaries), reduce(DataFrame.unionByName, snippets) if with_snippets else None


def _search_block(requests: list[Pattern], texts: DataFrame, filtered_out: bool, searcher: str,
                  index: StoredIndex | DataFrame | None) -> tuple[DataFrame, DataFrame, list[Pattern]]:
    """(summary, hits, patterns that were tried)."""
    spark = texts.sparkSession
    early = classify(requests)
    runnable = [p for p in requests if early[p.pattern_id] is None and searcher != "none" and not filtered_out]
    indexed = [p for p in runnable if searcher == "trigram" and not p.regex and len(p.pattern) >= TRIGRAM_SIZE]
    scanned = [p for p in runnable if p not in indexed]
    parts = [find_hits(texts, scanned)] if scanned else []
    if indexed:
        literals = spark.createDataFrame([(p.pattern_id, p.pattern) for p in indexed],
                                         "pattern_id string, pattern string")
        if isinstance(index, StoredIndex):
            pairs = index.candidates(literals)
        else:
            pairs = trigram_join(literals, trigram_index(texts) if index is None else index)
        candidates = pairs.groupBy("memory_id").agg(F.collect_set("pattern_id").alias("pattern_ids"))
        parts.append(find_hits(texts, indexed, candidates))
    # Totals and snippets both read the hits, which are found once.
    hits = cut_lineage(reduce(DataFrame.unionByName, parts)) if parts else spark.createDataFrame([], HITS_SCHEMA)

    status = (F.when(F.col("early").isin("empty-query", "short-query"), F.col("early"))
              .when(F.lit(filtered_out), "no-candidates")
              .when(F.col("early").isNotNull(), F.col("early"))
              .when(F.coalesce("total_matches", F.lit(0)) == 0, "no-matches")
              .otherwise("ok"))
    known = spark.createDataFrame([(p.pattern_id, early[p.pattern_id]) for p in requests], SUMMARY_SCHEMA)
    summary = known.join(search_totals(hits), "pattern_id", "left").select(
        "pattern_id", status.alias("status"),
        F.coalesce("total_matches", F.lit(0)).alias("total_matches"),
        F.coalesce("total_memories", F.lit(0)).alias("total_memories"))
    return summary, hits, runnable
