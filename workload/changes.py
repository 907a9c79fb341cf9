"""Merge, diff, update, delete and duplicate admission over documents, turns and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.constants import RESERVED_TAG
from anamnesis.functions.core import iso_millis
from anamnesis.functions.ids import content_etag
from anamnesis.operators import changes as C
from anamnesis.operators.dedup import near_duplicate_join, near_stored
from anamnesis.operators.embedding import HashedEmbedder, embed_distinct, embedding_plan, new_cache_rows
from anamnesis.operators.indexes import build_indexes, refresh_indexes
from anamnesis.plans import write as P
from anamnesis.plans.maintenance import dimension_audit, reembed
from anamnesis.session import cut_lineage
from anamnesis.sources.transcripts import assemble_sessions
from workload import frames as W
from workload import sqltext as Q
from workload.registry import query
from workload.retrieval import EMBEDDER, document_rows, document_vectors, embedded_documents
from workload.text import ALPHABETS, CHUNK_SQL

NOW = "2025-06-01T00:00:00.000Z"


def now():
    return F.to_timestamp(F.lit(NOW))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return W.load(spark, sf, "labels").select(W.document_id().alias("memory_id"), "quality", "toxic")


def with_labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents that have labels, and those that have none."""
    docs = document_rows(spark, sf)
    known = labelled(spark, sf).select("memory_id")
    return docs.join(known, "memory_id", "left_semi"), docs.join(known, "memory_id", "left_anti")


# --- identity of rows ---------------------------------------------------------------------------

@query("first_per_id",
       """SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def first_per_id_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.load(spark, sf, "events").select("user_id", "event_id", "event_type")
    return C.first_per_id(rows, "event_id", "user_id")


@query("ingest_anti_join", f"WITH {Q.TURNS} SELECT memory_id, md5(text) AS text_md5 FROM turns WHERE role <> 'user'")
def ingest_anti_join_all(spark: SparkSession, sf: str) -> DataFrame:
    """User turns are stored; the whole transcript arrives twice."""
    turns = W.turns(spark, sf)
    resent = turns.withColumn("input_order", F.lit(1)).unionByName(
        turns.withColumn("input_order", F.lit(2)).withColumn("text", F.upper("text")))
    fresh = C.ingest_anti_join(resent, turns.where("role = 'user'"), "input_order")
    return fresh.select("memory_id", F.md5("text").alias("text_md5"))


@query("delete_memories",
       f"""WITH {Q.DOCS}, {Q.TURNS} SELECT memory_id, 'kept' AS outcome FROM docs WHERE coalesce(toxic, 0) <> 1
       UNION ALL SELECT memory_id, 'unknown' FROM turns WHERE role = 'system'""")
def delete_all(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents go; the system turns among the ids are not stored here."""
    docs = document_rows(spark, sf)
    ids = labelled(spark, sf).where("toxic = 1").select("memory_id").unionByName(
        W.turns(spark, sf).where("role = 'system'").select("memory_id"))
    tables, unknown = C.delete_memories(ids, {"memories": docs})
    return tables["memories"].select("memory_id", F.lit("kept").alias("outcome")).unionByName(
        unknown.select("memory_id", F.lit("unknown").alias("outcome")))


HALVES = """e AS (SELECT user_id||':'||json_extract_string(props, '$.k') AS memory_id, ts, event_id FROM events),
  old AS (SELECT memory_id, max(event_id) AS version FROM e WHERE ts < timestamp '2024-01-16' GROUP BY 1),
  new AS (SELECT memory_id, max(event_id) AS version FROM e WHERE ts >= timestamp '2024-01-10' GROUP BY 1)"""
DIFF = f"""{HALVES}, diff AS (SELECT coalesce(o.memory_id, n.memory_id) AS memory_id,
    CASE WHEN o.memory_id IS NULL THEN 'added' WHEN n.memory_id IS NULL THEN 'removed'
         WHEN o.version <> n.version THEN 'updated' END AS change
  FROM old o FULL JOIN new n ON o.memory_id = n.memory_id)"""


def event_snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Latest event per user and key, in two overlapping windows of the month."""
    events = W.load(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.get_json_object("props", "$.k")).alias("memory_id"),
        "ts", "event_id")
    def snap(rows: DataFrame) -> DataFrame:
        return rows.groupBy("memory_id").agg(F.max("event_id").alias("version"))
    return snap(events.where("ts < timestamp_ntz '2024-01-16'")), snap(events.where("ts >= timestamp_ntz '2024-01-10'"))


@query("snapshot_diff", f"WITH {DIFF} SELECT memory_id, change FROM diff WHERE change IS NOT NULL")
def snapshot_diff_all(spark: SparkSession, sf: str) -> DataFrame:
    return C.snapshot_diff(*event_snapshots(spark, sf))


@query("sync_summary", f"""WITH {DIFF} SELECT count(*) FILTER (WHERE change = 'added') AS added,
       count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'removed') AS removed FROM diff""")
def sync_summary_all(spark: SparkSession, sf: str) -> DataFrame:
    return C.sync_summary(C.snapshot_diff(*event_snapshots(spark, sf)))


@query("same_rows", f"""WITH {DIFF} SELECT 'halves' AS pair, count(change) = 0 AS same FROM diff
       UNION ALL SELECT 'itself', true""")
def same_rows_all(spark: SparkSession, sf: str) -> DataFrame:
    old, new = event_snapshots(spark, sf)
    return C.same_rows(old, new).select(F.lit("halves").alias("pair"), "same").unionByName(
        C.same_rows(old, old).select(F.lit("itself").alias("pair"), "same"))


@query("copy_missing", f"WITH {Q.DOCS} SELECT memory_id FROM docs WHERE quality IS NULL")
def copy_missing_all(spark: SparkSession, sf: str) -> DataFrame:
    return C.copy_missing(document_rows(spark, sf).select("memory_id"), labelled(spark, sf))


@query("coverage_check", """SELECT 'documents' AS live, count(*) FILTER (WHERE d.doc_id IS NULL) AS missing,
       count(*) FILTER (WHERE d.doc_id IS NULL) = 0 AS covered FROM labels l LEFT JOIN documents d USING (doc_id)
       UNION ALL SELECT 'labels', count(*) FILTER (WHERE l.doc_id IS NULL), count(*) FILTER (WHERE l.doc_id IS NULL) = 0
       FROM documents d LEFT JOIN labels l USING (doc_id)""")
def coverage_all(spark: SparkSession, sf: str) -> DataFrame:
    docs, known = document_rows(spark, sf).select("memory_id"), labelled(spark, sf).select("memory_id")
    return C.coverage_check(docs, known).select(F.lit("documents").alias("live"), "missing", "covered").unionByName(
        C.coverage_check(known, docs).select(F.lit("labels").alias("live"), "missing", "covered"))


@query("link_replies",
       f"""WITH {Q.TURNS}, kept AS (SELECT * FROM turns WHERE role <> 'system')
       SELECT memory_id, parent_id, parent_id NOT IN (SELECT memory_id FROM kept) AS dangling FROM kept
       WHERE parent_id IS NOT NULL""")
def link_replies_all(spark: SparkSession, sf: str) -> DataFrame:
    return C.link_replies(W.turns(spark, sf).where("role <> 'system'"))


# --- updates ------------------------------------------------------------------------------------

ETAGS = f"""stored AS (SELECT *, md5(text||'|'||array_to_string(tags, ',')||'|'||{Q.iso('updated_at')}) AS etag FROM docs),
  changed AS (SELECT memory_id, quality, toxic FROM stored WHERE quality IS NOT NULL)"""


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = document_rows(spark, sf)
    return docs.withColumn("etag", content_etag("text", "tags", "updated_at")).select(*P.MEMORY_COLUMNS)


def document_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents are updated twice; the first update of low quality ones has an old etag,
    so that their second one applies; toxic ones drop their tags, the others keep them. System
    turns are not stored at all."""
    current = stored_documents(spark, sf).select("memory_id", "text", "etag")
    base = labelled(spark, sf).join(current, "memory_id").select(
        "memory_id", F.concat(F.lit("First. "), "text").alias("text"),
        F.when(F.col("toxic") == 1, F.array().cast("array<string>")).alias("tags"),
        F.when(F.col("quality") == 1, F.col("etag")).otherwise(F.lit("old")).alias("etag"),
        F.lit(1).cast("bigint").alias("update_order"))
    again = base.drop("etag").join(current.select("memory_id", "etag"), "memory_id").withColumn(
        "text", F.concat(F.lit("Second. "), "text")).withColumn("update_order", F.lit(2).cast("bigint")).select(*base.columns)
    missing = W.turns(spark, sf).where("role = 'system'").select(
        "memory_id", "text", F.lit(None).cast("array<string>").alias("tags"), F.lit("none").alias("etag"),
        F.lit(3).cast("bigint").alias("update_order"))
    return base.unionByName(again).unionByName(missing)


@query("apply_updates",
       f"""WITH {Q.DOCS} SELECT memory_id, md5(CASE WHEN quality = 1 THEN 'First. '||text WHEN quality = 0 THEN 'Second. First. '||text ELSE text END) AS text_md5,
       array_to_string(CASE WHEN quality IS NOT NULL AND toxic = 1 THEN [] ELSE tags END, ',') AS tags,
       CASE WHEN quality IS NOT NULL THEN '{NOW}' ELSE {Q.iso('updated_at')} END AS updated_at FROM docs""")
def apply_updates_all(spark: SparkSession, sf: str) -> DataFrame:
    stored = stored_documents(spark, sf)
    applicable, _ = C.resolve_updates(document_updates(spark, sf), stored)
    after = C.apply_updates(applicable, stored, now())
    return after.select("memory_id", F.md5("text").alias("text_md5"), F.array_join("tags", ",").alias("tags"),
                        iso_millis("updated_at").alias("updated_at"))


@query("stale_updates",
       f"""WITH {Q.DOCS}, {Q.TURNS} SELECT memory_id, 1 AS update_order, 'stale' AS reason FROM docs WHERE quality = 0
       UNION ALL SELECT memory_id, 2, 'stale' FROM docs WHERE quality = 1
       UNION ALL SELECT memory_id, 3, 'missing' FROM turns WHERE role = 'system'""")
def stale_updates_all(spark: SparkSession, sf: str) -> DataFrame:
    return C.resolve_updates(document_updates(spark, sf), stored_documents(spark, sf))[1]


@query("update_batch",
       rf"""{CHUNK_SQL.replace('text FROM documents)', "CASE WHEN quality = 1 THEN 'First. ' ELSE 'Second. First. ' END||text AS text FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)")}
       SELECT memory_id, count(*) AS chunk_count, md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS text_md5 FROM chunked GROUP BY 1""")
def update_batch_all(spark: SparkSession, sf: str) -> DataFrame:
    change = P.update_batch(document_updates(spark, sf), stored_documents(spark, sf), now())
    pieces = change.chunks.groupBy("memory_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return change.memories.select("memory_id", F.md5("text").alias("text_md5")).join(pieces, "memory_id")


@query("delete_batch", f"""WITH {Q.DOCS} SELECT memory_id, 'memory' AS row_of FROM docs WHERE coalesce(toxic, 0) <> 1
       UNION ALL SELECT memory_id, 'chunk' FROM docs WHERE coalesce(toxic, 0) <> 1""")
def delete_batch_all(spark: SparkSession, sf: str) -> DataFrame:
    memories, chunks = stored_documents(spark, sf), W.document_chunks(spark, sf)
    change = P.delete_batch(labelled(spark, sf).where("toxic = 1"), memories, chunks)
    left = P.applied(memories, change.memories, change.gone).select("memory_id", F.lit("memory").alias("row_of"))
    return left.unionByName(P.applied(chunks, change.chunks, change.gone).select("memory_id", F.lit("chunk").alias("row_of")))


@query("reconcile",
       f"""WITH {Q.DOCS} SELECT memory_id, md5(CASE WHEN toxic = 1 THEN text||' changed' ELSE text END) AS text_md5
       FROM docs WHERE lang <> 'de'""")
def reconcile_all(spark: SparkSession, sf: str) -> DataFrame:
    """The landed snapshot lacks German documents and holds toxic ones changed; the store lacks
    documents without labels."""
    docs = stored_documents(spark, sf)
    stored = docs.join(labelled(spark, sf), "memory_id", "left_semi")
    changed = F.when(F.array_contains("tags", "toxic"), F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    snapshot = docs.where(~F.array_contains("tags", "lang:de")).withColumn("text", changed)
    snapshot = snapshot.withColumn("etag", content_etag("text", "tags", "updated_at"))
    change = P.reconcile(snapshot, snapshot.select("memory_id", F.lit(0).alias("chunk_index"), "text"), stored)
    return P.applied(stored, change.memories, change.gone).select("memory_id", F.md5("text").alias("text_md5"))


# --- import -------------------------------------------------------------------------------------

def import_turns(spark: SparkSession, sf: str) -> DataFrame:
    """User and assistant turns, of which system turns were filtered out, with one session time."""
    turns = W.turns(spark, sf).where("role <> 'system'").withColumn(
        "created_at", F.when(F.col("turn_index") % 2 == 0, F.col("created_at")))
    return assemble_sessions(turns.withColumn("fallback_at", F.lit(None).cast("timestamp"))).withColumn(
        "tags", F.array(F.lit("source:chat")))


IMPORT = f"""{Q.TURNS}, kept AS (SELECT *, CASE WHEN turn_index % 2 = 0 THEN created_at END AS own_time FROM turns WHERE role <> 'system'),
  sess AS (SELECT conversation_id, arg_min(own_time, turn_index) FILTER (WHERE own_time IS NOT NULL) AS s FROM kept GROUP BY 1)"""


@query("ingest",
       f"""WITH {IMPORT} SELECT memory_id, conversation_id, parent_id, CAST(turn_index AS BIGINT) AS turn_index,
         'source:chat,mine' AS tags, {Q.iso("coalesce(own_time, s, timestamp '2025-06-01')")} AS created_at,
         {Q.iso("coalesce(own_time, s, timestamp '2025-06-01')")} AS updated_at
       FROM kept JOIN sess USING (conversation_id) WHERE role = 'assistant'""")
def ingest_all(spark: SparkSession, sf: str) -> DataFrame:
    """User turns are stored already."""
    stored = W.turns(spark, sf).where("role = 'user'")
    change = P.ingest(import_turns(spark, sf), stored, now(), ["mine"])
    return change.memories.select("memory_id", "conversation_id", "parent_id", "turn_index",
                                  F.array_join("tags", ",").alias("tags"), iso_millis("created_at").alias("created_at"),
                                  iso_millis("updated_at").alias("updated_at"))


@query("ingest_chunks", f"""{CHUNK_SQL.replace('SELECT ' + Q.DOC + ' AS memory_id, text FROM documents',
       'SELECT ' + Q.TURN + " AS memory_id, upper(role)||': '||text AS text FROM conversations WHERE role = 'assistant'")}
       SELECT memory_id, chunk_index, md5(text) AS text_md5, sha256(text) AS text_sha256 FROM chunked""")
def ingest_chunks_all(spark: SparkSession, sf: str) -> DataFrame:
    stored = W.turns(spark, sf).where("role = 'user'")
    change = P.ingest(import_turns(spark, sf), stored, now())
    return change.chunks.select("memory_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                                F.md5("text").alias("text_md5"), "text_sha256")


@query("ingest_report",
       f"""WITH {IMPORT} SELECT conversation_id, count(*) FILTER (WHERE role = 'assistant') AS added,
       count(*) FILTER (WHERE role = 'user') AS skipped FROM kept GROUP BY 1""")
def ingest_report_all(spark: SparkSession, sf: str) -> DataFrame:
    return P.ingest(import_turns(spark, sf), W.turns(spark, sf).where("role = 'user'"), now()).report


@query("ingest_stats",
       f"""WITH {IMPORT}, r AS (SELECT conversation_id, count(*) FILTER (WHERE role = 'assistant') AS a,
         count(*) FILTER (WHERE role = 'user') AS k FROM kept GROUP BY 1)
       SELECT count(*) FILTER (WHERE a > 0) AS written, count(*) FILTER (WHERE a = 0) AS all_present,
         CAST(sum(a) AS BIGINT) AS added, CAST(sum(k) AS BIGINT) AS skipped FROM r""")
def ingest_stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return P.ingest_stats(P.ingest(import_turns(spark, sf), W.turns(spark, sf).where("role = 'user'"), now()).report)


@query("ingest_preview", f"WITH {IMPORT} SELECT conversation_id, count(*) AS turns FROM kept GROUP BY 1")
def ingest_preview_all(spark: SparkSession, sf: str) -> DataFrame:
    return P.ingest_preview(import_turns(spark, sf))


# --- duplicates, cache, indexes -------------------------------------------------------------------

SPLIT_DOCS = f"""{Q.DOCS}, {Q.embedded('docs', 'memory_id', 'text', 'dv')},
  store AS MATERIALIZED (SELECT dv.* FROM dv JOIN docs USING (memory_id) WHERE quality IS NOT NULL),
  arriving AS MATERIALIZED (SELECT memory_id AS query_id, dv.v FROM dv JOIN docs USING (memory_id) WHERE quality IS NULL)"""


def arriving_and_stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents without labels arrive at a store of those with labels."""
    vectors = document_vectors(spark, sf)
    known = labelled(spark, sf).select("memory_id")
    arriving = vectors.join(known, "memory_id", "left_anti").join(
        W.document_memories(spark, sf).select("memory_id", F.col("doc_id").alias("input_order")), "memory_id")
    return arriving, vectors.join(known, "memory_id", "left_semi")


@query("near_duplicate_store",
       f"""WITH {SPLIT_DOCS}, {Q.knn('arriving', 'store', 1)}
       SELECT query_id AS memory_id, memory_id AS similar_id, round(1 - distance, 6) AS similarity
       FROM dense WHERE distance < 0.08""")
def near_stored_all(spark: SparkSession, sf: str) -> DataFrame:
    return near_stored(*arriving_and_stored(spark, sf))


NEAREST = f"""
  near AS MATERIALIZED (SELECT b.o, list(DISTINCT a.o) AS earlier FROM pieces a JOIN firsts b ON a.o < b.o AND {Q.distance('a.v', 'b.v')} < 0.08 GROUP BY 1),
  held AS MATERIALIZED (SELECT DISTINCT o FROM firsts CROSS JOIN store s WHERE {Q.distance('firsts.v', 's.v')} < 0.08),
  steps AS MATERIALIZED (SELECT f.memory_id, f.o, f.claims, f.o IN (SELECT o FROM held) AS stored_near, coalesce(near.earlier, []) AS earlier,
      row_number() OVER (ORDER BY f.o) AS i FROM firsts f LEFT JOIN near USING (o)),
  fold AS (
    SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, false AS taken, NULL::BIGINT AS o, NULL::VARCHAR AS outcome
    UNION ALL
    SELECT s.i, CASE WHEN (s.claims AND taken) OR s.stored_near OR list_has_any(kept, s.earlier) THEN kept ELSE list_append(kept, s.o) END,
      taken OR (s.claims AND NOT s.stored_near AND NOT list_has_any(kept, s.earlier)), s.o,
      CASE WHEN s.claims AND taken THEN 'reserved' WHEN s.stored_near OR list_has_any(kept, s.earlier) THEN 'duplicate' ELSE 'accepted' END
    FROM fold JOIN steps s ON s.i = fold.i + 1),
  there AS MATERIALIZED (SELECT s.memory_id, -1 AS o, s.v FROM store s
    UNION ALL SELECT p.memory_id, p.o, p.v FROM pieces p JOIN fold USING (o) WHERE outcome = 'accepted'),
  alike AS (SELECT f.o, t.memory_id AS similar_id, round(1 - {Q.distance('f.v', 't.v')}, 6) AS similarity
    FROM firsts f JOIN fold USING (o) JOIN there t ON t.o < f.o WHERE outcome = 'duplicate'
    QUALIFY row_number() OVER (PARTITION BY f.o ORDER BY {Q.distance('f.v', 't.v')}, t.memory_id) = 1)"""


@query("near_duplicate_join",
       f"""WITH RECURSIVE {SPLIT_DOCS},
       firsts AS MATERIALIZED (SELECT query_id AS memory_id, doc_id AS o, v, false AS claims FROM arriving JOIN docs ON memory_id = query_id),
       pieces AS (SELECT memory_id, o, v FROM firsts), {NEAREST}
       SELECT memory_id, outcome = 'accepted' AS accepted, similar_id, similarity FROM firsts JOIN fold USING (o) LEFT JOIN alike USING (o)""")
def near_duplicate_all(spark: SparkSession, sf: str) -> DataFrame:
    """The rule as SQL states it: one row after another, each against what was kept before it."""
    return near_duplicate_join(*arriving_and_stored(spark, sf))


ARRIVING_CHUNKS = CHUNK_SQL.replace(
    f"SELECT {Q.DOC} AS memory_id, text FROM documents",
    f"SELECT {Q.DOC} AS memory_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


@query("write_batch",
       f"""{ARRIVING_CHUNKS}, {Q.DOCS}, {Q.embedded('docs', 'memory_id', 'text', 'dv')},
       store AS MATERIALIZED (SELECT dv.* FROM dv JOIN docs USING (memory_id) WHERE quality IS NOT NULL),
       parts AS (SELECT memory_id||'#'||chunk_index AS part_id, memory_id, chunk_index, text FROM chunked),
       {Q.embedded('parts', 'part_id', 'text', 'pv')},
       pieces AS MATERIALIZED (SELECT parts.memory_id, chunk_index, doc_id AS o, pv.v, lang = 'fr' AS claims FROM parts JOIN pv USING (part_id) JOIN docs USING (memory_id)),
       firsts AS MATERIALIZED (SELECT memory_id, o, v, claims FROM pieces WHERE chunk_index = 0), {NEAREST}
       SELECT memory_id, coalesce(outcome, 'empty') AS outcome, similar_id, similarity
       FROM d LEFT JOIN firsts USING (memory_id) LEFT JOIN fold USING (o) LEFT JOIN alike USING (o)""")
def write_batch_all(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled documents are written to a store of the labelled ones; French ones claim the reserved tag."""
    arriving, stored = arriving_and_stored(spark, sf)
    docs = document_rows(spark, sf)
    rows = docs.join(arriving.select("memory_id", "input_order"), "memory_id").select(
        "memory_id", "text", F.when(F.array_contains("tags", "lang:fr"), F.array(F.lit(RESERVED_TAG))).alias("tags"), "input_order")
    memories = docs.join(stored.select("memory_id"), "memory_id", "left_semi")
    return P.write_batch(rows, memories, stored, EMBEDDER, now()).report


@query("update_claims",
       f"""WITH RECURSIVE {Q.DOCS}, lowest AS (SELECT min(memory_id) AS h FROM docs WHERE toxic = 1),
       ups AS (SELECT memory_id, doc_id AS o, toxic = 1 AND memory_id <> h AS claims, memory_id = h AS releases,
           quality = 1 OR memory_id = h AS current, false AS blank FROM docs, lowest WHERE quality IS NOT NULL
         UNION ALL SELECT memory_id, 1000000 + doc_id, true, false, true, lang = 'fr' FROM docs WHERE toxic = 1
         UNION ALL SELECT memory_id, 2000000 + turn, false, false, false, false FROM ({f"WITH {Q.TURNS} SELECT * FROM turns WHERE role = 'system'"})),
       steps AS (SELECT *, row_number() OVER (ORDER BY o, memory_id) AS i FROM ups),
       fold AS (
         SELECT 0::BIGINT AS i, h AS holder, []::VARCHAR[] AS spent, NULL::VARCHAR AS memory_id, NULL::BIGINT AS o, NULL::VARCHAR AS reason FROM lowest
         UNION ALL
         SELECT i, CASE WHEN reason = 'applied' AND claims THEN memory_id WHEN reason = 'applied' AND releases AND holder = memory_id THEN NULL ELSE holder END,
           CASE WHEN reason = 'applied' THEN list_append(spent, memory_id) ELSE spent END, memory_id, o, reason
         FROM (SELECT s.i, f.holder, f.spent, s.memory_id, s.o, s.claims, s.releases,
             CASE WHEN s.claims AND f.holder IS NOT NULL AND f.holder <> s.memory_id THEN 'reserved' WHEN s.o >= 2000000 THEN 'missing'
               WHEN s.blank THEN 'empty' WHEN NOT s.current OR list_contains(f.spent, s.memory_id) THEN 'stale' ELSE 'applied' END AS reason
           FROM fold f JOIN steps s ON s.i = f.i + 1))
       SELECT memory_id, CASE WHEN reason = 'applied' THEN -1 ELSE o END AS update_order, reason FROM fold WHERE i > 0""")
def update_claims_all(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents claim the reserved tag, in vain until its holder lets it go, and again later."""
    stored = stored_documents(spark, sf)
    flags = labelled(spark, sf).join(W.document_memories(spark, sf).select("memory_id", "doc_id", F.array_contains(
        "tags", "lang:fr").alias("french")), "memory_id")
    holder = flags.where("toxic = 1").agg(F.min("memory_id")).first()[0]
    tag, holds = F.array(F.lit(RESERVED_TAG)), F.col("memory_id") == F.lit(holder)
    memories = stored.withColumn("tags", F.when(holds, tag).otherwise(F.col("tags")))
    known = flags.join(stored.select("memory_id", "text", "etag"), "memory_id")
    first = known.select(
        "memory_id", "text", F.when(holds, F.array(F.lit("released"))).when(F.col("toxic") == 1, tag).alias("tags"),
        F.when((F.col("quality") == 1) | holds, F.col("etag")).otherwise(F.lit("old")).alias("etag"),
        F.col("doc_id").cast("bigint").alias("update_order"))
    later = known.where("toxic = 1").select(
        "memory_id", F.when(F.col("french"), F.lit(" ")).otherwise(F.col("text")).alias("text"), tag.alias("tags"), "etag",
        (F.col("doc_id") + 1_000_000).cast("bigint").alias("update_order"))
    missing = W.turns(spark, sf).where("role = 'system'").select(
        "memory_id", "text", F.lit(None).cast("array<string>").alias("tags"), F.lit("none").alias("etag"),
        (F.col("turn_index") + 2_000_000).cast("bigint").alias("update_order"))
    change = P.update_batch(first.unionByName(later).unionByName(missing), memories, now())
    applied = change.gone.select("memory_id", F.lit(-1).cast("bigint").alias("update_order"), F.lit("applied").alias("reason"))
    return change.report.select(*applied.columns).unionByName(applied)


@query("embedding_plan",
       """WITH d AS (SELECT DISTINCT sha256(text) AS h FROM documents),
       c AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id))
       SELECT count(*) AS distinct_texts, count(c.h) AS cached, count(*) - count(c.h) AS to_embed FROM d LEFT JOIN c USING (h)""")
def embedding_plan_all(spark: SparkSession, sf: str) -> DataFrame:
    known, _ = with_labels(spark, sf)
    cache = new_cache_rows(known, EMBEDDER, None)
    return embedding_plan(document_rows(spark, sf), EMBEDDER, cache)


@query("embed_with_cache",
       f"""WITH {Q.DOCS} SELECT memory_id, true AS same FROM docs""")
def embed_with_cache_all(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors through a half-filled cache equal vectors without one."""
    known, _ = with_labels(spark, sf)
    docs = W.document_chunks(spark, sf)
    cached = embed_distinct(docs, EMBEDDER, cut_lineage(new_cache_rows(known, EMBEDDER, None)))
    plain = embedded_documents(spark, sf).select("memory_id", F.col("vector").alias("plain"))
    return cached.join(plain, "memory_id").select("memory_id", (F.col("vector") == F.col("plain")).alias("same"))


@query("refresh_indexes",
       f"""WITH {Q.DOCS}, after AS (SELECT memory_id, CASE WHEN quality = 1 THEN text||' renewed text' ELSE text END AS text
         FROM docs WHERE coalesce(toxic, 0) <> 1),
       t AS (SELECT memory_id, {Q.tokens('text')} AS toks FROM after),
       p AS (SELECT memory_id, unnest(toks) AS term FROM t),
       tf AS (SELECT term, memory_id, count(*) AS tf FROM p GROUP BY 1, 2),
       chars AS (SELECT memory_id, string_split(translate(text, {ALPHABETS}), '') AS c FROM after),
       grams AS (SELECT memory_id, unnest(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i]||c[i+1]||c[i+2]))) AS g FROM chars)
       SELECT 'corpus' AS part, '' AS term, count(*) AS a, CAST(sum(len(toks)) AS BIGINT) AS b FROM t
       UNION ALL SELECT 'term', term, count(*), CAST(sum(tf) AS BIGINT) FROM tf GROUP BY term
       UNION ALL SELECT 'trigram', g, count(*), 0 FROM grams GROUP BY g""")
def refresh_indexes_all(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents leave and good ones are rewritten: the moved statistics equal a rebuild."""
    docs, chunks = document_rows(spark, sf), W.document_chunks(spark, sf)
    flags = labelled(spark, sf)
    gone = flags.where("toxic = 1 OR quality = 1").select("memory_id")
    back = flags.where("quality = 1 AND toxic <> 1").select("memory_id")
    renewed = chunks.join(back, "memory_id", "left_semi").withColumn("text", F.concat("text", F.lit(" renewed text")))
    stored = build_indexes(chunks, docs)
    after = refresh_indexes(stored, chunks, gone, renewed, renewed)
    terms = after["term_stats"].join(after["postings"].groupBy("term").agg(F.sum("tf").alias("b")), "term").select(
        F.lit("term").alias("part"), "term", F.col("df").alias("a"), "b")
    return after["corpus_stats"].select(F.lit("corpus").alias("part"), F.lit("").alias("term"),
                                        F.col("n_docs").alias("a"), F.col("total_len").alias("b")).unionByName(terms).unionByName(
        after["trigrams"].groupBy(F.col("trigram").alias("term")).agg(F.count(F.lit(1)).alias("a")).select(
            F.lit("trigram").alias("part"), "term", "a", F.lit(0).cast("bigint").alias("b")))


@query("dimension_audit", "SELECT bool_and(len(embedding) = 64) AS holds FROM embeddings WHERE vec_id % 4 = 0")
def dimension_audit_all(spark: SparkSession, sf: str) -> DataFrame:
    return dimension_audit(W.vector_chunks(spark, sf), 64)


@query("reembed", f"WITH {Q.DOCS} SELECT memory_id, 'hashed-64' AS model, true AS same FROM docs")
def reembed_all(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the rows are staged by an earlier run; the rest completes the table."""
    docs = W.document_chunks(spark, sf)
    known, _ = with_labels(spark, sf)
    staged = cut_lineage(reembed(docs.join(known, "memory_id", "left_semi"), HashedEmbedder()))
    whole = staged.unionByName(reembed(docs, HashedEmbedder(), staged))
    plain = embedded_documents(spark, sf).select("memory_id", F.col("vector").alias("plain"))
    return whole.join(plain, "memory_id").select("memory_id", "model", (F.col("vector") == F.col("plain")).alias("same"))
