"""Encrypted rows over the documents. The keys are fixed so that results repeat; a real job is
given its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.core import iso_millis
from anamnesis.session import cut_lineage
from anamnesis.sources.envelopes import integrity_audit, read_envelopes, rotate_key, write_envelopes
from workload import frames as W
from workload import sqltext as Q
from workload.registry import query
from workload.retrieval import document_rows, embedded_documents

OLD_KEY, NEW_KEY, OTHER_KEY = (bytes([b]) * 32 for b in (1, 2, 3))


def sealed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(write_envelopes(document_rows(spark, sf), embedded_documents(spark, sf), OLD_KEY))


@query("envelope_round_trip",
       f"""WITH {Q.DOCS} SELECT memory_id, md5(text) AS text_md5, array_to_string(tags, ',') AS tags,
       {Q.iso('updated_at')} AS updated_at, CAST(64 AS BIGINT) AS dimensions FROM docs""")
def envelope_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Encrypted, half of it rotated by an interrupted run, the rest rotated, then read back."""
    sealed = sealed_documents(spark, sf)
    known = W.load(spark, sf, "labels").select(W.document_id().alias("memory_id"))
    staged = cut_lineage(rotate_key(sealed.join(known, "memory_id", "left_semi"), OLD_KEY, NEW_KEY))
    rotated = staged.unionByName(cut_lineage(rotate_key(sealed, OLD_KEY, NEW_KEY, staged)))
    memories, chunks, _ = read_envelopes(rotated, NEW_KEY)
    texts = chunks.select("memory_id", F.md5("text").alias("text_md5"), F.size("vector").cast("bigint").alias("dimensions"))
    return memories.join(texts, "memory_id").select(  # what is compared is joined, not the texts themselves
        "memory_id", "text_md5", F.array_join("tags", ",").alias("tags"),
        iso_millis("updated_at").alias("updated_at"), "dimensions")


@query("integrity_audit",
       """WITH d AS (SELECT lang, coalesce(toxic, 0) AS toxic, coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id)),
       r AS (SELECT CASE WHEN toxic = 1 THEN 'chunks-authentication' WHEN lang = 'fr' THEN 'meta-missing'
         WHEN lang = 'de' AND quality = 1 THEN 'meta-authentication' ELSE 'ok' END AS reason FROM d)
       SELECT 'right' AS key, reason, count(*) AS rows FROM r GROUP BY 2
       UNION ALL SELECT 'other', CASE WHEN lang = 'fr' AND toxic <> 1 THEN 'meta-missing' ELSE 'wrong-key' END, count(*) FROM d GROUP BY 2""")
def integrity_audit_all(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic rows have their payloads swapped, French ones lost the metadata, good German ones
    carry altered metadata; the whole is also audited under a key that fits nothing."""
    tags = document_rows(spark, sf).select("memory_id", "tags")
    rows = sealed_documents(spark, sf).join(tags, "memory_id")
    has = lambda tag: F.array_contains("tags", tag)
    chunks = F.when(has("toxic"), F.col("meta")).otherwise(F.col("chunks"))
    altered = F.col("meta").withField("tag", F.base64(F.lit("0123456789abcdef").cast("binary")))
    meta = (F.when(has("toxic"), F.col("chunks")).when(has("lang:fr"), F.lit(None))
            .when(has("lang:de") & has("quality"), altered).otherwise(F.col("meta")))
    tampered = rows.select("memory_id", chunks.alias("chunks"), meta.alias("meta"))
    right = integrity_audit(tampered, OLD_KEY).select(F.lit("right").alias("key"), "reason", "rows")
    return right.unionByName(integrity_audit(tampered, OTHER_KEY).select(F.lit("other").alias("key"), "reason", "rows"))
