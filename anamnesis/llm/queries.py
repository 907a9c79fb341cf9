"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm import (clusters, decontaminate, langid, licenses, minhash, packing, passages, pii, quality, tokens,
                           topk, toxicity, variants)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


@query("op3_exact_top_k", """
    WITH sound AS (
        SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        GROUP BY vec_id),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_personal_data")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op10_repeated_passages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def _cluster_sql(rounds: int = 3, clusters: int = 16, factor: int = 64) -> str:
    """The rounds of `op11` as one chain of tables: c<i> are the centroids, a<i> the assignments."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
    d{i} AS (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
             FROM parts v JOIN c{i} c USING (dim) GROUP BY v.row, c.cluster),
    a{i} AS (SELECT row, cluster, distance FROM d{i}
             QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""
    m{i} AS (SELECT a.cluster, v.dim, sum(v.x)::BIGINT AS total, count(*)::BIGINT AS n
             FROM a{i} a JOIN parts v USING (row) GROUP BY a.cluster, v.dim),
    c{i + 1} AS (SELECT c.cluster, c.dim, CASE WHEN m.n IS NULL THEN c.x
                    ELSE (m.total - ((m.total % m.n) + m.n) % m.n) // m.n END AS x
             FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster AND m.dim = c.dim)""")
    last = rounds
    return f"""
    WITH kept AS (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, embedding AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (
        SELECT row, dim, floor({factor} * v[dim]::DOUBLE)::BIGINT AS x
        FROM kept, (SELECT unnest(generate_series(1, 64)) AS dim)),
    first AS (
        SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS cluster
        FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {clusters}),
    c0 AS (SELECT first.cluster, parts.dim, parts.x FROM first JOIN parts USING (row)),{",".join(steps)},
    digest AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256
               FROM c{last} GROUP BY cluster)
    SELECT k.vec_id, a.cluster::INTEGER AS cluster, a.distance,
           sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
           sum(a.distance) OVER ()::BIGINT AS inertia, digest.centroid_sha256
    FROM a{last} a JOIN kept k USING (row) JOIN digest ON digest.cluster = a.cluster"""


@query("op11_centroid_clusters", _cluster_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_quality_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))
