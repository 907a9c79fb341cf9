"""BM25 over chunks: postings built inside rows, scores summed where the chunk already lies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.constants import BM25_B, BM25_K1
from anamnesis.functions.core import is_row, rows_of
from anamnesis.functions.text import term_counts, tokenize
from anamnesis.operators.kernels import BestRows, TermScores
from anamnesis.operators.ranking import top_k
from anamnesis.operators.sizing import (
    BROADCAST_MAX_BYTES,
    BROADCAST_MAX_ROWS,
    attach,
    fits_broadcast,
    measure,
    salt_of,
    salted_join,
)
from anamnesis.session import cut_lineage, read_tables, write_table

#: How far below the bound of a broadcast the blocks of a large query side are.
BLOCK_SPARE = 2
SCORE_DECIMALS = 6
SCORE_CELLS = 2_000_000  # documents x queries scored at a time inside a task
SCORE_TOKENS = 250_000  # tokens looked up at a time inside a task
SCORE_SCHEMA = "query_id string, memory_id string, chunk_index int, score double"
CHUNK = ["memory_id", "chunk_index"]


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """One row per chunk: (memory_id, chunk_index, doc_len, terms). Empty chunks are kept."""
    tokens = chunks.select("memory_id", F.col("chunk_index").cast("int").alias("chunk_index"),
                           tokenize("text").alias("tokens"))
    return tokens.select(*CHUNK, F.size("tokens").alias("doc_len"), term_counts(F.col("tokens")).alias("terms"))


def build_postings(terms: DataFrame) -> DataFrame:
    """(term, memory_id, chunk_index, tf, doc_len), straight out of the rows: no shuffle."""
    return (terms.select(*CHUNK, "doc_len", rows_of(F.col("terms"), "t")).where(is_row("t"))
            .select("t.term", *CHUNK, "t.tf", "doc_len"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row; chunks without any token count towards N."""
    return terms.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"),
    ).withColumn("avgdl", F.col("total_len") / F.nullif("n_docs", F.lit(0)))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct tokens of each query."""
    return queries.select(F.col("query_id").cast("string").alias("query_id"),
                          rows_of(F.array_distinct(tokenize("query_text")), "term")).where(is_row("term"))


def _idf(df: Column, n_docs: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def _saturation(tf: Column, doc_len: Column, avgdl: Column) -> Column:
    norm = 1 - BM25_B + BM25_B * doc_len / avgdl
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * norm)


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """One row per chunk with its token list; chunks without a token are kept."""
    return chunks.select("memory_id", F.col("chunk_index").cast("int").alias("chunk_index"),
                         tokenize("text").alias("tokens"))


def asked_stats(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """df of the wanted terms and, under a null term, N (df) and the total length, in one pass.

    Each chunk contributes a null term beside its own distinct ones, so corpus and term
    statistics come out of the same partial aggregate, whose size is that of the query side.
    """
    marked = tokens.select(F.size("tokens").alias("doc_len"),
                           rows_of(F.array_append(F.array_distinct("tokens"), F.lit(None)), "term"))
    everything = wanted.select(F.col("term").alias("asked")).distinct().unionByName(
        wanted.sparkSession.createDataFrame([(None,)], "asked string"))
    return (marked.join(F.broadcast(everything), F.col("term").eqNullSafe(F.col("asked")), "left_semi")
            .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("doc_len").alias("total_len")))


def bm25_join(queries: DataFrame, chunks: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """`k` best chunks per query by a scan: (query_id, memory_id, chunk_index, score, rank).

    The weighted query terms travel to every task once measured small; each task scores the
    chunks it holds and keeps its own k best per query, so only queries x tasks x k rows
    shuffle and a term found in a third of all chunks moves no data. A larger query side is taken in
    blocks of whole queries that can travel, a scan for each; only a block that cannot is
    joined to postings on salted terms, a row per query and posting. A filter narrows the scored chunks only: document
    frequencies stay those of the whole corpus.
    """
    wanted = query_terms(queries)
    if fits_broadcast(wanted):
        return _bm25_by_scan(wanted, chunks, k, allowed)
    best = [_bm25_of_block(part, chunks, k, allowed) for part in query_blocks(queries, wanted)]
    return best[0] if len(best) == 1 else read_tables(best[0], [write_table(one) for one in best])


def _bm25_by_scan(wanted: DataFrame, chunks: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    tokens = chunk_tokens(chunks)
    scored = tokens if allowed is None else attach(
        tokens, allowed.select("memory_id").distinct(), "memory_id", "left_semi", even=True)
    return _rank_scores(_score_by_scan(scored, wanted, asked_stats(tokens, wanted), k), k)


def _bm25_of_block(queries: DataFrame, chunks: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    wanted = query_terms(queries)
    if fits_broadcast(wanted):
        return _bm25_by_scan(wanted, chunks, k, allowed)
    terms = chunk_terms(chunks)
    postings = build_postings(terms)
    if allowed is not None:
        postings = attach(postings, allowed.select("memory_id").distinct(), "memory_id", "left_semi", even=True)
    return bm25_from_index(queries, postings, term_stats(build_postings(terms)), corpus_stats(terms), k)


def query_blocks(queries: DataFrame, wanted: DataFrame) -> list[DataFrame]:
    """The queries in blocks whose terms fit a broadcast if they are spread evenly. Rows of one query id stay together."""
    rows, size = measure(wanted)
    blocks = max(math.ceil(BLOCK_SPARE * rows / BROADCAST_MAX_ROWS), math.ceil(BLOCK_SPARE * size / BROADCAST_MAX_BYTES))
    if rows <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES:
        return [queries]
    dealt = cut_lineage(queries.select("query_id", "query_text", salt_of([F.col("query_id").cast("string")], blocks).alias("_block")))
    return [dealt.where(F.col("_block") == block) for block in range(blocks)]


def _rank_scores(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("memory_id"), F.asc("chunk_index")], k)


def _pieces(tokens: pa.Array, documents: int) -> Iterator[tuple[int, int]]:
    """(first, rows) of pieces of `documents` texts and `SCORE_TOKENS` tokens at most; one longer text is a piece."""
    ends = np.cumsum(np.maximum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), 0))
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        stop = min(max(int(np.searchsorted(ends, before + SCORE_TOKENS, "right")), first + 1), first + documents, len(ends))
        yield first, stop - first
        first = stop


def alike(weights: list[tuple[str, str, float]]) -> dict[str, list[str]]:
    """Queries by the one that stands for them: those whose terms that the corpus knows are the same score alike."""
    terms: dict[str, set[str]] = {}
    for query, term, _ in weights:
        terms.setdefault(query, set()).add(term)
    stands: dict[frozenset[str], list[str]] = {}
    for query in sorted(terms):
        stands.setdefault(frozenset(terms[query]), []).append(query)
    return {queries[0]: queries for queries in stands.values()}


def _score_by_scan(tokens: DataFrame, wanted: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    counted = stats.toArrow().to_pylist()
    corpus = next((r for r in counted if r["term"] is None), None)
    n_docs, avgdl = (corpus["df"], corpus["total_len"] / corpus["df"]) if corpus else (0, 0.0)
    weights = _weights(wanted, {r["term"]: r["df"] for r in counted if r["term"] is not None}, n_docs)
    groups = alike(weights)
    stood_for = sum(map(len, groups.values())) > len(groups)
    weights = [w for w in weights if w[0] in groups]
    shared = tokens.sparkSession.sparkContext.broadcast((weights, avgdl))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, mean_length = shared.value
        if not rows:
            return
        scorer = TermScores(rows, mean_length, BM25_K1, BM25_B)
        state = BestRows(len(scorer.query_ids), k)
        step = max(1, SCORE_CELLS // len(scorer.query_ids))
        for batch in batches:
            for start, rows_at_once in _pieces(batch["tokens"], step):
                part = batch.slice(start, rows_at_once)
                scores = np.round(scorer.score(part["tokens"]), SCORE_DECIMALS)
                state.add(part["memory_id"].to_pylist(), part["chunk_index"].to_pylist(),
                          np.where(scores > 0, -scores, np.inf))
        yield from state.table(scorer.query_ids, -1.0, "score").to_batches()

    found = tokens.mapInArrow(best, SCORE_SCHEMA)
    if not stood_for:
        return found
    members = tokens.sparkSession.createDataFrame(
        pa.table({"query_id": pa.array([first for first, queries in groups.items() for _ in queries], pa.string()),
                  "asked": pa.array([q for queries in groups.values() for q in queries], pa.string())}))
    best_of = _rank_scores(found, k).join(F.broadcast(members), "query_id")
    return best_of.select(F.col("asked").alias("query_id"), *CHUNK, "score")


def bm25_from_index(queries: DataFrame, postings: DataFrame, frequency: DataFrame, corpus: DataFrame,
                    k: int, allowed: DataFrame | None = None) -> DataFrame:
    """`k` best chunks per query from postings: only those of asked terms are moved.

    The postings of a chunk meet in one task, each once and not once per query that asks for it;
    the task scores the chunk for all queries and keeps its own k best per query. A query side too large to
    send is joined to the postings on salted terms.
    """
    wanted = query_terms(queries)
    if allowed is not None:
        postings = attach(postings, allowed.select("memory_id").distinct(), "memory_id", "left_semi", even=True)
    if fits_broadcast(wanted):
        return _rank_scores(_score_postings(postings, wanted, frequency, corpus, k), k)
    n_docs, avgdl = (corpus.select(c).scalar() for c in ("n_docs", "avgdl"))
    weights = wanted.join(frequency, "term").select("query_id", "term", _idf(F.col("df"), n_docs).alias("idf"))
    scored = (salted_join(postings, weights, ["term"]).groupBy("query_id", *CHUNK)
              .agg(F.round(F.sum(F.col("idf") * _saturation(F.col("tf"), F.col("doc_len"), avgdl)),
                           SCORE_DECIMALS).alias("score")))
    return _rank_scores(scored, k)


def _weights(wanted: DataFrame, df: dict[str, int], n_docs: int) -> list[tuple[str, str, float]]:
    idf = {t: math.log((n_docs - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
    asked = wanted.toArrow()
    asked = asked.filter(pc.is_in(asked["term"], pa.array(list(idf), pa.string())))  # most may be unknown to the corpus
    return [(q, t, idf[t]) for q, t in zip(*asked.to_pydict().values())]


def _score_postings(postings: DataFrame, wanted: DataFrame, frequency: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    asked = wanted.select("term").distinct()
    total = corpus.select("n_docs", "avgdl").first()
    df = {r["term"]: r["df"] for r in frequency.join(F.broadcast(asked), "term", "left_semi").toArrow().to_pylist()}
    weights = _weights(wanted, df, total.n_docs or 0)
    shared = postings.sparkSession.sparkContext.broadcast((weights, total.avgdl or 0.0))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, mean_length = shared.value
        if not rows:
            return
        scorer = TermScores(rows, mean_length, BM25_K1, BM25_B)
        state = BestRows(len(scorer.query_ids), k)
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            starts = _chunk_starts(part)
            last = int(starts[-1]) if len(starts) else 0  # the last chunk may go on in the next batch
            _add_chunks(state, scorer, part.slice(0, last), starts[:-1])
            held = part.slice(last)
        if held is not None:
            _add_chunks(state, scorer, held, _chunk_starts(held))
        yield from state.table(scorer.query_ids, -1.0, "score").to_batches()

    matched = postings.join(F.broadcast(asked), "term", "left_semi").select(*CHUNK, "doc_len", "term", "tf")
    return matched.repartition(*CHUNK).sortWithinPartitions(*CHUNK).mapInArrow(best, SCORE_SCHEMA)


def _chunk_starts(part: pa.Table) -> np.ndarray:
    """Where each chunk begins in rows sorted by chunk."""
    if not part.num_rows:
        return np.zeros(0, np.int64)
    ids = part["memory_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    place = part["chunk_index"].to_numpy()
    head = np.ones(part.num_rows, dtype=bool)
    head[1:] = (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])
    return np.flatnonzero(head)


def _add_chunks(state: BestRows, scorer: TermScores, part: pa.Table, starts: np.ndarray) -> None:
    step = max(1, SCORE_CELLS // len(scorer.query_ids))
    ends = np.append(starts[1:], part.num_rows)
    for low in range(0, len(starts), step):
        first, stop = starts[low:low + step], int(ends[min(low + step, len(starts)) - 1])
        piece = part.slice(int(first[0]), stop - int(first[0]))
        doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, stop)))
        flat = scorer.score_postings(doc, len(first), piece["doc_len"].to_numpy()[first - first[0]].astype(np.int64),
                                     piece["term"].combine_chunks(), piece["tf"].to_numpy().astype(np.int64))
        scores = np.round(flat, SCORE_DECIMALS)
        heads = part.take(pa.array(first))
        state.add(heads["memory_id"].to_pylist(), heads["chunk_index"].to_pylist(), np.where(scores > 0, -scores, np.inf))


def bm25_per_haystack(questions: DataFrame, haystack: DataFrame, k: int) -> DataFrame:
    """BM25 where every question is its own corpus: df, N and average length are per question.

    `haystack` has query_id, memory_id and text.
    """
    docs = haystack.select("query_id", "memory_id", tokenize("text").alias("tokens"))
    docs = docs.select("query_id", "memory_id", F.size("tokens").alias("doc_len"),
                       term_counts(F.col("tokens")).alias("terms"))
    corpus = docs.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_docs"), (F.sum("doc_len") / F.count(F.lit(1))).alias("avgdl"))
    asked = questions.select("query_id", F.array_distinct(tokenize("query_text")).alias("asked"))
    # Terms nobody asks for drop out inside the row, before anything is exploded or shuffled.
    narrowed = attach(docs, asked, "query_id").select(
        "query_id", "memory_id", "doc_len",
        rows_of(F.filter("terms", lambda t: F.array_contains("asked", t["term"])), "t")).where(is_row("t"))
    matched = narrowed.select("query_id", "memory_id", "doc_len", "t.term", "t.tf")
    df = matched.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = (df.join(corpus, "query_id")
               .select("query_id", "term", "avgdl", _idf(F.col("df"), F.col("n_docs")).alias("idf")))
    scored = (salted_join(matched, weights, ["query_id", "term"])
              .groupBy("query_id", "memory_id")
              .agg(F.round(F.sum(F.col("idf") * _saturation(F.col("tf"), F.col("doc_len"), F.col("avgdl"))),
                           SCORE_DECIMALS).alias("score")))
    return top_k(scored.withColumn("chunk_index", F.lit(0)), ["query_id"],
                 [F.desc("score"), F.asc("memory_id")], k)
