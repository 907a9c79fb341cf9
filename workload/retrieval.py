"""Vector, lexical and fused retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.vectors import cosine_distance
from anamnesis.operators import bm25 as B
from anamnesis.operators.ann import ann_join, ann_recall
from anamnesis.operators.embedding import HashedEmbedder, embed_column, embed_distinct
from anamnesis.operators.filters import MetaFilter, allowed_ids, cold_query_gate, relevant
from anamnesis.operators.fusion import best_memories, collapse_chunks, fetch_depth, rrf_fuse
from anamnesis.operators.knn import knn_join
from anamnesis.operators.ranking import leg_ranks, top_k
from anamnesis.plans.recall import recall_hybrid, recall_semantic
from anamnesis.session import cut_lineage, settled
from workload import frames as W
from workload import sqltext as Q
from workload.registry import query

EMBEDDER = HashedEmbedder()
ENGLISH = MetaFilter(tags=("lang:en",))
HIT = "query_id, memory_id, CAST(chunk_index AS BIGINT) AS chunk_index, distance, rank"


def hits_out(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.select(*[F.col(c).cast("bigint").alias(c) if c in ("rank", "chunk_index") else F.col(c)
                         for c in columns])


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks for its neighbours."""
    return W.vector_chunks(spark, sf).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("query_id"),
                                             F.col("vector").alias("query_vector"))


def embedded_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their vectors, materialised once as the stored chunk table would be."""
    return settled(spark, lambda: embed_distinct(W.document_chunks(spark, sf), EMBEDDER))


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The same chunks without their texts, which admission does not read."""
    return settled(spark, lambda: embed_distinct(W.document_chunks(spark, sf), EMBEDDER).select("memory_id", "chunk_index", "vector"))


def embedded_queries(spark: SparkSession, sf: str) -> DataFrame:
    return embed_column(W.text_queries(spark, sf), EMBEDDER, "query_text", "query_vector")


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    return W.document_memories(spark, sf).withColumn("chunk_count", F.lit(1))


VQ = "vq AS (SELECT 'v'||vec_id AS query_id, v FROM vecs)"
EMBED_DOCS = Q.embedded("docs", "memory_id", "text", "dv")
EMBED_ASKED = Q.embedded("asked", "query_id", "query_text", "qv")
DENSE_TEXT = f"{Q.DOCS}, {Q.QUERIES}, {EMBED_DOCS}, {EMBED_ASKED}"


@query("knn_join", f"WITH {Q.VECTORS}, {VQ}, {Q.knn('vq', 'vecs', 10, chunk='c.chunk_index')} SELECT {HIT} FROM dense")
def knn_join_all(spark: SparkSession, sf: str) -> DataFrame:
    hits = knn_join(vector_queries(spark, sf), W.vector_chunks(spark, sf), 10)
    return hits_out(hits, "query_id", "memory_id", "chunk_index", "distance", "rank")


@query("knn_join_filtered",
       f"""WITH {Q.VECTORS}, {VQ},
       {Q.knn('vq', 'vecs', 10, allowed='SELECT memory_id FROM vecs WHERE label = 3', chunk='c.chunk_index')}
       SELECT {HIT} FROM dense""")
def knn_join_filtered(spark: SparkSession, sf: str) -> DataFrame:
    chunks = W.vector_chunks(spark, sf)
    hits = knn_join(vector_queries(spark, sf), chunks, 10, chunks.where("label = 3").select("memory_id"))
    return hits_out(hits, "query_id", "memory_id", "chunk_index", "distance", "rank")


@query("relevance_cutoff",
       f"""WITH {Q.VECTORS}, {VQ}, {Q.knn('vq', 'vecs', 100, chunk='c.chunk_index')}
       SELECT {HIT} FROM dense WHERE distance < 0.5""")
def relevance_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    hits = relevant(knn_join(vector_queries(spark, sf), W.vector_chunks(spark, sf), fetch_depth(5)))
    return hits_out(hits, "query_id", "memory_id", "chunk_index", "distance", "rank")


@query("collapse_chunks",
       f"""WITH {Q.VECTORS}, {VQ}, {Q.knn('vq', 'vecs', 100, chunk='c.chunk_index')}
       SELECT query_id, memory_id, min(rank) AS rank, CAST(arg_min(chunk_index, rank) AS BIGINT) AS chunk_index,
              arg_min(distance, rank) AS distance FROM dense GROUP BY 1, 2""")
def collapse_all(spark: SparkSession, sf: str) -> DataFrame:
    hits = collapse_chunks(knn_join(vector_queries(spark, sf), W.vector_chunks(spark, sf), fetch_depth(5)))
    return hits_out(hits, "query_id", "memory_id", "rank", "chunk_index", "distance")


@query("cosine_distance",
       f"""WITH {Q.VECTORS}, centre AS (SELECT label, list(x ORDER BY i) AS c FROM (
         SELECT label, i, sum(x) AS x FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(v) AS x FROM vecs)
         GROUP BY 1, 2) GROUP BY 1)
       SELECT vec_id, {Q.distance('v', 'c')} AS distance FROM vecs JOIN centre USING (label)""")
def cosine_distance_all(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every vector to the sum of its label's vectors, as array expressions."""
    chunks = W.vector_chunks(spark, sf)
    centre = (chunks.select("label", F.posexplode("vector").alias("i", "x"))
              .groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
              .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
              .select("label", F.col("c.x").alias("centre")))
    return chunks.join(F.broadcast(centre), "label").select(
        "vec_id", F.round(cosine_distance("vector", "centre"), 6).alias("distance"))


@query("embed_column", f"""WITH {Q.DOCS}, {EMBED_DOCS}
       SELECT memory_id, array_to_string(list_transform(v, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',') AS vector FROM dv""")
def embed_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = embedded_documents(spark, sf)
    micro = F.transform("vector", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string"))
    return rows.select("memory_id", F.array_join(micro, ",").alias("vector"))


@query("bm25_join", f"""WITH {Q.DOCS}, {Q.QUERIES}, {Q.bm25('docs')}
       SELECT query_id, memory_id, score, rank FROM sparse""")
def bm25_all(spark: SparkSession, sf: str) -> DataFrame:
    hits = B.bm25_join(W.text_queries(spark, sf), W.document_chunks(spark, sf), 10)
    return hits_out(hits, "query_id", "memory_id", "score", "rank")


@query("bm25_join_filtered",
       f"""WITH {Q.DOCS}, {Q.QUERIES},
       {Q.bm25('docs', allowed="SELECT memory_id FROM docs WHERE list_contains(tags, 'lang:en')")}
       SELECT query_id, memory_id, score, rank FROM sparse""")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    allowed = allowed_ids(W.document_memories(spark, sf), ENGLISH)
    hits = B.bm25_join(W.text_queries(spark, sf), W.document_chunks(spark, sf), 10, allowed)
    return hits_out(hits, "query_id", "memory_id", "score", "rank")


@query("build_postings",
       f"""WITH {Q.TURNS}, t AS (SELECT memory_id, {Q.tokens('text')} AS toks FROM turns),
       p AS (SELECT memory_id, len(toks) AS doc_len, unnest(toks) AS term FROM t)
       SELECT term, memory_id, count(*) AS tf, any_value(doc_len) AS doc_len FROM p GROUP BY 1, 2""")
def postings_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.build_postings(B.chunk_terms(W.turn_chunks(spark, sf)))
    return rows.select("term", "memory_id", F.col("tf").cast("bigint").alias("tf"),
                       F.col("doc_len").cast("bigint").alias("doc_len"))


@query("term_stats",
       f"""WITH {Q.DOCS}, t AS (SELECT memory_id, unnest(list_distinct({Q.tokens('text')})) AS term FROM docs)
       SELECT term, count(*) AS df FROM t GROUP BY 1""")
def term_stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return B.term_stats(B.build_postings(B.chunk_terms(W.document_chunks(spark, sf))))


@query("corpus_stats",
       f"""WITH {Q.DOCS}, t AS (SELECT len({Q.tokens('text')}) AS n FROM docs)
       SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total_len, round(sum(n)::DOUBLE / count(*), 6) AS avgdl FROM t""")
def corpus_stats_all(spark: SparkSession, sf: str) -> DataFrame:
    stats = B.corpus_stats(B.chunk_terms(W.document_chunks(spark, sf)))
    return stats.withColumn("avgdl", F.round("avgdl", 6))


def legs(spark: SparkSession, sf: str, depth: int, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    docs = embedded_documents(spark, sf)
    queries = embedded_queries(spark, sf)
    return knn_join(queries, docs, depth, allowed), B.bm25_join(queries, docs, depth, allowed)


@query("rrf_fuse",
       f"""WITH {DENSE_TEXT}, {Q.bm25('docs', k=100)}, {Q.knn('qv', 'dv', 100)}, {Q.fused(20)}
       SELECT query_id, memory_id, score, rank, distance FROM fused""")
def rrf_all(spark: SparkSession, sf: str) -> DataFrame:
    return hits_out(rrf_fuse(20, *legs(spark, sf, 100)), "query_id", "memory_id", "score", "rank", "distance")


@query("leg_rank",
       f"""WITH {Q.VECTORS} SELECT CAST(label AS VARCHAR) AS query_id, vec_id,
       row_number() OVER (PARTITION BY label ORDER BY v[1] DESC, vec_id) AS rank FROM vecs""")
def leg_rank_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.vector_chunks(spark, sf).select(F.col("label").cast("string").alias("query_id"), "vec_id",
                                             F.col("vector")[0].alias("x"))
    return leg_ranks(rows, [F.desc("x"), F.asc("vec_id")]).select("query_id", "vec_id", F.col("rank").cast("bigint"))


@query("top_k",
       """SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank
       FROM events QUALIFY rank <= 3""")
def top_k_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.load(spark, sf, "events").select("user_id", "event_id", "value")
    return top_k(rows, ["user_id"], [F.desc("value"), F.asc("event_id")], 3).withColumn("rank", F.col("rank").cast("bigint"))


@query("cold_query_gate",
       f"""WITH {Q.TURNS}, {Q.VECTORS}, asked AS (SELECT 'p'||page_id AS query_id, url AS query_text FROM pages),
       {Q.embedded('turns', 'memory_id', 'text', 'dv')}, {Q.embedded('asked', 'query_id', 'query_text', 'qv')},
       {Q.bm25('turns', k=10)}, {Q.knn('qv', 'dv', 10)}, {Q.fused(10)},
       warm AS (SELECT query_id FROM dense WHERE rank = 1 AND distance < 0.8 UNION SELECT query_id FROM sparse)
       SELECT query_id, count(*) AS hits FROM fused WHERE query_id IN (SELECT query_id FROM warm) GROUP BY 1""")
def cold_gate_all(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as queries against the turns."""
    asked = W.load(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("query_id"),
                                              F.col("url").alias("query_text"))
    queries = cut_lineage(embed_column(asked, EMBEDDER, "query_text", "query_vector"))
    chunks = settled(spark, lambda: embed_distinct(W.turn_chunks(spark, sf), EMBEDDER))
    dense, sparse = cut_lineage(knn_join(queries, chunks, 10)), cut_lineage(B.bm25_join(queries, chunks, 10))
    kept = cold_query_gate(rrf_fuse(10, dense, sparse), dense, sparse)
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))


RECALL_OUT = """SELECT query_id, rank, memory_id, array_to_string(tags, ',') AS tags, md5(text) AS text_md5, distance
  FROM best JOIN docs USING (memory_id)"""


def recall_out(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), "memory_id",
                       F.array_join("tags", ",").alias("tags"), F.md5("text").alias("text_md5"), "distance")


@query("recall_semantic",
       f"""WITH {DENSE_TEXT}, {Q.knn('qv', 'dv', 100)},
       best AS (SELECT query_id, memory_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
         FROM dense WHERE distance < 0.5 QUALIFY rank <= 5) {RECALL_OUT}""")
def recall_semantic_all(spark: SparkSession, sf: str) -> DataFrame:
    return recall_out(recall_semantic(W.text_queries(spark, sf), document_rows(spark, sf),
                                      embedded_documents(spark, sf), 5, embedder=EMBEDDER))


def hybrid_sql(k: int, allowed: str | None = None) -> str:
    return f"""WITH {DENSE_TEXT}, {Q.bm25('docs', k=100, allowed=allowed)},
       {Q.knn('qv', 'dv', 100, allowed=allowed)}, {Q.fused(100)},
       warm AS (SELECT query_id FROM dense WHERE rank = 1 AND distance < 0.8 UNION SELECT query_id FROM sparse),
       best AS (SELECT query_id, memory_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY fused.rank) AS rank
         FROM fused WHERE distance < 0.5 AND query_id IN (SELECT query_id FROM warm) QUALIFY rank <= {k}) {RECALL_OUT}"""


@query("recall_hybrid", hybrid_sql(5))
def recall_hybrid_all(spark: SparkSession, sf: str) -> DataFrame:
    return recall_out(recall_hybrid(W.text_queries(spark, sf), document_rows(spark, sf),
                                    embedded_documents(spark, sf), 5, embedder=EMBEDDER))


@query("recall_hybrid_filtered", hybrid_sql(5, "SELECT memory_id FROM docs WHERE list_contains(tags, 'lang:en')"))
def recall_hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return recall_out(recall_hybrid(W.text_queries(spark, sf), document_rows(spark, sf),
                                    embedded_documents(spark, sf), 5, ENGLISH, EMBEDDER))


@query("best_memories",
       f"""WITH {Q.VECTORS}, {VQ}, {Q.knn('vq', 'vecs', 100, chunk='c.chunk_index')},
       c AS (SELECT query_id, memory_id, min(rank) AS r, CAST(arg_min(chunk_index, rank) AS BIGINT) AS chunk_index,
             arg_min(distance, rank) AS distance FROM dense GROUP BY 1, 2)
       SELECT query_id, memory_id, chunk_index, distance, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank
       FROM c QUALIFY rank <= 5""")
def best_memories_all(spark: SparkSession, sf: str) -> DataFrame:
    hits = best_memories(knn_join(vector_queries(spark, sf), W.vector_chunks(spark, sf), fetch_depth(5)), 5)
    return hits_out(hits, "query_id", "memory_id", "chunk_index", "distance", "rank")


@query("ann_join_ivf")
def ann_ivf(spark: SparkSession, sf: str) -> DataFrame:
    return ann_join(vector_queries(spark, sf), W.vector_chunks(spark, sf), 10, method="ivf")


@query("ann_join_lsh")
def ann_lsh(spark: SparkSession, sf: str) -> DataFrame:
    return ann_join(vector_queries(spark, sf), W.vector_chunks(spark, sf), 10, method="lsh")


@query("ann_recall", """SELECT unnest(['ivf', 'lsh']) AS method, true AS reached, 10 * count(*) AS exact_hits FROM embeddings""")
def ann_recall_all(spark: SparkSession, sf: str) -> DataFrame:
    """Both methods find at least nine in ten of the exact neighbours."""
    queries, chunks = vector_queries(spark, sf), W.vector_chunks(spark, sf)
    exact = knn_join(queries, chunks, 10)
    rows = None
    for method in ("ivf", "lsh"):
        one = ann_recall(ann_join(queries, chunks, 10, method=method), exact).withColumn("method", F.lit(method))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("method", (F.col("recall") >= 0.9).alias("reached"), "exact_hits")
