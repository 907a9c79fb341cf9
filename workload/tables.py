"""Filters, listings and summaries over documents, turns and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.core import iso_millis
from anamnesis.functions.ids import is_valid_id
from anamnesis.functions.text import accept_role, role_line
from anamnesis.functions.times import end_of_day
from anamnesis.operators import listing as L
from anamnesis.operators.changes import all_match, concat_tags
from anamnesis.operators.filters import (
    MetaFilter,
    drop_empty,
    is_abstention,
    is_scorable,
    meta_filter,
    reserved_holder,
    reserved_tag_rule,
    split_valid_ids,
)
from anamnesis.plans.listing import list_memories
from anamnesis.sources.transcripts import assemble_sessions
from workload import frames as W
from workload import sqltext as Q
from workload.registry import query
from workload.retrieval import EMBEDDER, document_rows, embedded_documents

BUSY = MetaFilter(tags=("lang:en", "source:src1"), exclude_tags=("toxic",), start="2024-01-01T00:30:00Z",
                  end="2024-01-05")
BUSY_SQL = """(list_contains(tags, 'lang:en') OR list_contains(tags, 'source:src1')) AND NOT list_contains(tags, 'toxic')
  AND updated_at >= timestamp '2024-01-01 00:30:00' AND updated_at <= timestamp '2024-01-05 23:59:59.999'"""


def ids_and_time(rows: DataFrame) -> DataFrame:
    return rows.select("memory_id", iso_millis("updated_at").alias("updated_at"))


@query("meta_filter", f"WITH {Q.DOCS} SELECT memory_id, {Q.iso('updated_at')} AS updated_at FROM docs WHERE {BUSY_SQL}")
def meta_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return ids_and_time(meta_filter(W.document_memories(spark, sf), BUSY))


@query("tag_union", f"""WITH {Q.DOCS} SELECT memory_id, {Q.iso('updated_at')} AS updated_at FROM docs
       WHERE list_contains(tags, 'toxic') OR list_contains(tags, 'lang:fr')""")
def tag_union(spark: SparkSession, sf: str) -> DataFrame:
    return ids_and_time(meta_filter(W.document_memories(spark, sf), MetaFilter(tags=("toxic", "lang:fr"))))


@query("end_of_day",
       """SELECT event_id, strftime(ts, '%Y-%m-%d')||'T23:59:59.999Z' AS day_end,
          strftime(ts, '%Y-%m-%dT%H:%M:%S')||'Z' AS exact_end FROM events""")
def end_of_day_all(spark: SparkSession, sf: str) -> DataFrame:
    events = W.load(spark, sf, "events")
    return events.select("event_id", end_of_day(F.date_format("ts", "yyyy-MM-dd")).alias("day_end"),
                         end_of_day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("exact_end"))


@query("is_valid_id",
       f"""WITH {Q.TURNS} SELECT memory_id, true AS own, parent_id IS NOT NULL AS parent, false AS plain FROM turns""")
def is_valid_id_all(spark: SparkSession, sf: str) -> DataFrame:
    raw = W.turns(spark, sf)
    return raw.select("memory_id", is_valid_id("memory_id").alias("own"), is_valid_id("parent_id").alias("parent"),
                      is_valid_id(F.upper("memory_id")).alias("plain"))


@query("split_valid_ids",
       f"""WITH {Q.TURNS}, r AS (SELECT CASE WHEN role = 'system' THEN upper(memory_id) ELSE memory_id END AS memory_id,
         role FROM turns) SELECT memory_id, role <> 'system' AS accepted FROM r""")
def split_valid_ids_all(spark: SparkSession, sf: str) -> DataFrame:
    """System turns get a malformed id and are split off."""
    bad = F.when(F.col("role") == "system", F.upper("memory_id")).otherwise(F.col("memory_id"))
    good, rejected = split_valid_ids(W.turns(spark, sf).withColumn("memory_id", bad), "memory_id")
    return good.select("memory_id", F.lit(True).alias("accepted")).unionByName(
        rejected.select("memory_id", F.lit(False).alias("accepted")))


@query("accept_role",
       """SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role END AS kept FROM conversations""")
def accept_role_all(spark: SparkSession, sf: str) -> DataFrame:
    return W.load(spark, sf, "conversations").select("conv_id", "turn", accept_role(F.upper("role")).alias("kept"))


@query("role_line", "SELECT conv_id, turn, md5(upper(role)||': '||text) AS line_md5 FROM conversations")
def role_line_all(spark: SparkSession, sf: str) -> DataFrame:
    return W.load(spark, sf, "conversations").select("conv_id", "turn", F.md5(role_line("role", "text")).alias("line_md5"))


@query("drop_empty",
       """SELECT lang, count(*) FILTER (WHERE trim(t) <> '') AS kept, count(*) FILTER (WHERE trim(t) = '') AS empty
          FROM (SELECT lang, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,'||chr(10), '') AS t
                FROM documents) GROUP BY 1""")
def drop_empty_all(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each document without plain letters and stops: often nothing."""
    bare = F.translate("text", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,\n", "")
    kept, empty = drop_empty(W.load(spark, sf, "documents").select("lang", bare.alias("text")))
    both = kept.select("lang", F.lit(1).alias("k"), F.lit(0).alias("e")).unionByName(
        empty.select("lang", F.lit(0).alias("k"), F.lit(1).alias("e")))
    return both.groupBy("lang").agg(F.sum("k").alias("kept"), F.sum("e").alias("empty"))


RESERVED = """tagged AS (SELECT *, CASE WHEN toxic = 1 THEN true ELSE false END AS mark FROM docs)"""


def reserved_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents carry the reserved tag, so several claim what only one may hold."""
    docs = W.document_memories(spark, sf)
    tag = F.when(F.array_contains("tags", "toxic"), F.array(F.lit("_index"))).otherwise(F.array().cast("array<string>"))
    return docs.withColumn("tags", F.concat("tags", tag)).withColumn("input_order", F.col("doc_id"))


@query("reserved_holder", f"WITH {Q.DOCS} SELECT min(memory_id) AS holder FROM docs WHERE toxic = 1")
def reserved_holder_all(spark: SparkSession, sf: str) -> DataFrame:
    return reserved_holder(reserved_documents(spark, sf))


@query("reserved_tag_rule",
       f"""WITH {Q.DOCS}, {RESERVED}, first AS (SELECT min(doc_id) AS d FROM tagged WHERE mark),
       holder AS (SELECT min(memory_id) AS h FROM tagged WHERE mark)
       SELECT memory_id, 'ingest' AS kind, NOT mark AS ok FROM tagged
       UNION ALL SELECT memory_id, 'write', NOT mark OR doc_id = d FROM tagged, first
       UNION ALL SELECT memory_id, 'update', NOT mark OR memory_id = h FROM tagged, holder""")
def reserved_tag_rule_all(spark: SparkSession, sf: str) -> DataFrame:
    """Imports and writes against a store without a holder, updates against one with a holder."""
    rows = reserved_documents(spark, sf)
    plain = W.document_memories(spark, sf)
    result = None
    for kind, stored in (("ingest", plain), ("write", plain), ("update", rows)):
        one = reserved_tag_rule(rows, stored, kind).select("memory_id", F.lit(kind).alias("kind"),
                                                           F.col("reserved_ok").alias("ok"))
        result = one if result is None else result.unionByName(one)
    return result


@query("abstention_and_scorable",
       """SELECT page_id, contains(url, '_abs') AS abstention, len(regexp_extract_all(url, '[0-9]+')) > 0 AS scorable
          FROM pages""")
def abstention_all(spark: SparkSession, sf: str) -> DataFrame:
    pages = W.load(spark, sf, "pages")
    return pages.select("page_id", is_abstention("url").alias("abstention"),
                        is_scorable(F.regexp_extract_all("url", F.lit("([0-9]+)"))).alias("scorable"))


@query("recent", f"""WITH {Q.DOCS} SELECT memory_id, {Q.iso('updated_at')} AS updated_at FROM docs
       ORDER BY docs.updated_at DESC, memory_id LIMIT 10""")
def recent_all(spark: SparkSession, sf: str) -> DataFrame:
    return ids_and_time(L.recent(W.document_memories(spark, sf), 10))


@query("in_range", f"""WITH {Q.TURNS} SELECT memory_id, {Q.iso('created_at')} AS updated_at FROM turns
       WHERE created_at >= timestamp '2024-01-02 00:00:00' AND created_at <= timestamp '2024-01-03 23:59:59.999'
       ORDER BY created_at DESC, memory_id LIMIT 50""")
def in_range_all(spark: SparkSession, sf: str) -> DataFrame:
    return ids_and_time(L.in_range(W.turns(spark, sf), "2024-01-02T00:00:00Z", "2024-01-03", 50))


@query("by_tags", f"""WITH {Q.DOCS} SELECT memory_id, {Q.iso('updated_at')} AS updated_at FROM docs
       WHERE list_contains(tags, 'lang:de') OR list_contains(tags, 'toxic') ORDER BY docs.updated_at DESC, memory_id LIMIT 25""")
def by_tags_all(spark: SparkSession, sf: str) -> DataFrame:
    return ids_and_time(L.by_tags(W.document_memories(spark, sf), ["lang:de", "toxic"], 25))


@query("tag_counts", f"""WITH {Q.DOCS}, t AS (SELECT unnest(list_distinct(tags)) AS tag FROM docs)
       SELECT tag, count(*) AS memories FROM t GROUP BY 1""")
def tag_counts_all(spark: SparkSession, sf: str) -> DataFrame:
    return L.tag_counts(W.document_memories(spark, sf))


@query("conversation_summary",
       f"""WITH {Q.TURNS} SELECT conversation_id, count(*) AS memories, {Q.iso('min(created_at)')} AS earliest
       FROM turns GROUP BY 1""")
def conversation_summary_all(spark: SparkSession, sf: str) -> DataFrame:
    return L.conversation_summary(W.turns(spark, sf)).withColumn("earliest", iso_millis("earliest"))


def branching_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns whose parent is half-way back, so that most parents have two children."""
    raw = W.load(spark, sf, "conversations")
    half = F.floor((F.col("turn") - 1) / 2)
    parents = raw.select(W.turn_id().alias("memory_id"),
                         F.when(F.col("turn") > 0, W.turn_id(turn=half)).alias("parent_id"))
    return W.turns(spark, sf).drop("parent_id").join(parents, "memory_id")


@query("conversation_entries",
       f"""WITH {Q.TURNS}, f AS (SELECT conversation_id, branch_id FROM turns WHERE branch_id IS NOT NULL
         GROUP BY 1, 2 HAVING count(*) > 1)
       SELECT conversation_id, memory_id, {Q.iso('created_at')} AS created_at, md5(text) AS text_md5,
         f.branch_id AS fork_from FROM turns LEFT JOIN f USING (conversation_id, branch_id)""")
def conversation_entries_all(spark: SparkSession, sf: str) -> DataFrame:
    return L.conversation_entries(branching_turns(spark, sf)).select(
        "conversation_id", "memory_id", iso_millis("created_at").alias("created_at"), F.md5("text").alias("text_md5"),
        "fork_from")


@query("memory_detail",
       f"""WITH {Q.TURNS} SELECT memory_id, conversation_id, parent_id, tag AS tags, {Q.iso('created_at')} AS created_at,
       md5(text) AS text_md5 FROM turns WHERE role = 'assistant'""")
def memory_detail_all(spark: SparkSession, sf: str) -> DataFrame:
    turns = W.turns(spark, sf)
    ids = turns.where("role = 'assistant'").select("memory_id")
    return L.memory_detail(ids, turns, W.turn_chunks(spark, sf)).select(
        "memory_id", "conversation_id", "parent_id", F.array_join("tags", ",").alias("tags"), "created_at",
        F.md5("text").alias("text_md5"))


@query("store_summary", f"WITH {Q.DOCS} SELECT count(*) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM docs")
def store_summary_all(spark: SparkSession, sf: str) -> DataFrame:
    return L.store_summary(W.document_memories(spark, sf))


@query("all_match", """SELECT (SELECT bool_and(len(embedding) = 64) FROM embeddings) AS vectors,
       (SELECT bool_and(n_chars > 100) FROM documents) AS long_texts""")
def all_match_all(spark: SparkSession, sf: str) -> DataFrame:
    vectors = all_match(W.load(spark, sf, "embeddings"), F.size("embedding") == 64).scalar()
    return all_match(W.load(spark, sf, "documents"), F.col("n_chars") > 100).select(
        vectors.alias("vectors"), F.col("holds").alias("long_texts"))


@query("concat_tags", f"""WITH {Q.DOCS} SELECT memory_id,
       array_to_string(list_concat(tags, ['import', 'lang:en']), ',') AS tags FROM docs""")
def concat_tags_all(spark: SparkSession, sf: str) -> DataFrame:
    return W.document_memories(spark, sf).select(
        "memory_id", F.array_join(concat_tags("tags", ["import", "lang:en"]), ",").alias("tags"))


@query("assemble_sessions",
       f"""WITH {Q.TURNS}, timed AS (SELECT *, CASE WHEN role <> 'system' THEN created_at END AS own_time FROM turns),
       s AS (SELECT conversation_id, coalesce(arg_min(own_time, turn_index) FILTER (WHERE own_time IS NOT NULL),
             min(created_at)) AS session_at FROM timed GROUP BY 1)
       SELECT memory_id, conversation_id, {Q.iso('session_at')} AS session_at FROM timed JOIN s USING (conversation_id)""")
def assemble_sessions_all(spark: SparkSession, sf: str) -> DataFrame:
    """System turns lose their time; a conversation of only those falls back to its own."""
    turns = W.turns(spark, sf).withColumn("fallback_at", F.lit(None).cast("timestamp"))
    own = turns.groupBy("conversation_id").agg(F.min("created_at").alias("fallback_at"))
    timed = turns.drop("fallback_at").join(own, "conversation_id").withColumn(
        "created_at", F.when(F.col("role") != "system", F.col("created_at")))
    return assemble_sessions(timed).select("memory_id", "conversation_id", iso_millis("session_at").alias("session_at"))


LISTED = f"""{Q.DOCS}, {Q.QUERIES}, {Q.embedded('docs', 'memory_id', 'text', 'dv')},
  {Q.embedded('asked', 'query_id', 'query_text', 'qv')}"""


@query("list_ranked",
       f"""WITH {LISTED}, {Q.knn('qv', 'dv', 200, allowed="SELECT memory_id FROM docs WHERE list_contains(tags, 'quality')")},
       best AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r
         FROM dense WHERE distance < 0.5 QUALIFY r <= 10),
       rest AS (SELECT query_id, memory_id, updated_at FROM asked CROSS JOIN docs
         WHERE list_contains(tags, 'quality') AND (query_id, memory_id) NOT IN (SELECT query_id, memory_id FROM best)),
       both_parts AS (SELECT query_id, memory_id, 0 AS part, r AS place FROM best
         UNION ALL SELECT query_id, memory_id, 1, -epoch_us(updated_at) FROM rest),
       listed AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY part, place, memory_id) AS rank
         FROM both_parts QUALIFY rank <= 10)
       SELECT query_id, memory_id, rank, {Q.iso('updated_at')} AS updated_at, md5(text) AS text_md5
       FROM listed JOIN docs USING (memory_id)""")
def list_ranked_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = list_memories(document_rows(spark, sf), embedded_documents(spark, sf), MetaFilter(tags=("quality",)),
                         W.text_queries(spark, sf), 10, "semantic", EMBEDDER)
    return rows.select("query_id", "memory_id", F.col("rank").cast("bigint").alias("rank"), "updated_at",
                       F.md5("text").alias("text_md5"))


@query("list_memories",
       f"""WITH {Q.DOCS} SELECT memory_id, {Q.iso('updated_at')} AS updated_at, md5(text) AS text_md5 FROM docs
       WHERE {BUSY_SQL} ORDER BY docs.updated_at DESC, memory_id LIMIT 20""")
def list_memories_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = list_memories(document_rows(spark, sf), W.document_chunks(spark, sf), BUSY, k=20)
    return rows.select("memory_id", "updated_at", F.md5("text").alias("text_md5"))
