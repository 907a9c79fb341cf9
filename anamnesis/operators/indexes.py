"""Derived tables kept right under change, without a rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.operators.bm25 import build_postings, chunk_terms, corpus_stats, term_stats
from anamnesis.operators.changes import without_ids
from anamnesis.operators.search import trigram_index
from anamnesis.operators.sizing import attach
from anamnesis.session import cut_lineage


def build_indexes(chunks: DataFrame, memories: DataFrame) -> dict[str, DataFrame]:
    """Every derived table from scratch, each written once; what is summed up comes from written tables."""
    terms = chunk_terms(chunks)
    postings = cut_lineage(build_postings(terms))
    return {"postings": postings, "term_stats": cut_lineage(term_stats(postings)),
            "corpus_stats": cut_lineage(corpus_stats(terms)), "trigrams": cut_lineage(trigram_index(memories))}


def refresh_indexes(indexes: dict[str, DataFrame], old_chunks: DataFrame, gone: DataFrame,
                    new_chunks: DataFrame, new_memories: DataFrame) -> dict[str, DataFrame]:
    """Derived tables after the memories in `gone` left and the new ones arrived.

    A replaced memory is in both, so adding one again never counts twice. Statistics move by
    the difference that the touched rows make; untouched postings are only filtered by id.
    """
    new_terms = chunk_terms(new_chunks)
    new_postings = build_postings(new_terms)
    gone_ids = gone.select("memory_id").distinct()
    lost_postings = attach(indexes["postings"], gone_ids, "memory_id", "left_semi", even=True)
    lost_chunks = chunk_terms(attach(old_chunks, gone_ids, "memory_id", "left_semi", even=True))

    moves = (new_postings.select("term", F.lit(1).alias("d"))
             .unionByName(lost_postings.select("term", F.lit(-1).alias("d"))))
    stats = (indexes["term_stats"].select("term", "df")
             .unionByName(moves.groupBy("term").agg(F.sum("d").alias("df")))
             .groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"))

    def totals(terms: DataFrame, sign: int) -> DataFrame:
        return terms.agg((sign * F.count(F.lit(1))).alias("n_docs"),
                         (sign * F.coalesce(F.sum("doc_len"), F.lit(0))).alias("total_len"))

    corpus = (indexes["corpus_stats"].select("n_docs", "total_len")
              .unionByName(totals(new_terms, 1)).unionByName(totals(lost_chunks, -1))
              .agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
              .withColumn("avgdl", F.col("total_len") / F.nullif("n_docs", F.lit(0))))
    return {
        "postings": without_ids(indexes["postings"], gone_ids).unionByName(new_postings),
        "term_stats": stats,
        "corpus_stats": corpus,
        "trigrams": without_ids(indexes["trigrams"], gone_ids).unionByName(trigram_index(new_memories)),
    }
