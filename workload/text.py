"""Text functions over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions import ids as I
from anamnesis.functions import text as T
from anamnesis.functions.chunking import chunk_text
from anamnesis.functions.core import is_row, iso_millis, numbered_rows_of, rows_of
from anamnesis.functions.linear_regex import regex_ranges
from anamnesis.functions.matching import literal_count, match_ranges, snippet
from anamnesis.functions.times import from_epoch_ms, from_epoch_seconds, from_iso
from anamnesis.plans.evaluation import session_document
from workload import frames as W
from workload import sqltext as Q
from workload.registry import query


@query("tokenize", f"""WITH {Q.DOCS}, t AS (SELECT memory_id, {Q.tokens('text')} AS toks FROM docs)
       SELECT memory_id, len(toks) AS n, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM t""")
def tokenize_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.document_memories(spark, sf).select("memory_id", T.tokenize("text").alias("t"))
    return rows.select("memory_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


ALPHABETS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("ascii_lower", f"SELECT doc_id, md5(translate(text, {ALPHABETS})) AS lower_md5 FROM documents")
def ascii_lower_all(spark: SparkSession, sf: str) -> DataFrame:
    return W.load(spark, sf, "documents").select("doc_id", F.md5(T.ascii_lower("text")).alias("lower_md5"))


@query("trigrams", f"""WITH d AS (SELECT doc_id, string_split(translate(text, {ALPHABETS}), '') AS c FROM documents),
       t AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i]||c[i+1]||c[i+2]))) AS g FROM d)
       SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS grams_md5 FROM t GROUP BY 1""")
def trigrams_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.load(spark, sf, "documents").select("doc_id", T.trigrams("text").alias("g"))
    return rows.select("doc_id", F.size("g").cast("bigint").alias("n"),
                       F.md5(F.array_join(F.array_sort("g"), "")).alias("grams_md5"))


SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)"
CHUNK_SQL = rf"""WITH RECURSIVE
  d AS (SELECT {Q.DOC} AS memory_id, text FROM documents),
  para AS (SELECT memory_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi
    FROM (SELECT memory_id, string_split_regex(text, '\n{{2,}}') AS ps FROM d WHERE length(text) > 1600)),
  cut AS (SELECT memory_id, pi, string_split(regexp_replace(trim(p, {SPACES}), '([.!?])\s+([A-Z"''])', '\1'||chr(1)||'\2', 'g'), chr(1)) AS ss
    FROM para WHERE trim(p, {SPACES}) <> ''),
  sent AS (SELECT memory_id, pi, unnest(ss) AS s, generate_subscripts(ss, 1) AS si FROM cut),
  ordered AS (SELECT memory_id, s, row_number() OVER (PARTITION BY memory_id ORDER BY pi, si) AS n
    FROM sent WHERE trim(s, {SPACES}) <> ''),
  long_piece AS (
    SELECT memory_id, n, 0 AS k, '' AS piece, s AS rest FROM ordered WHERE length(s) > 1600
    UNION ALL
    SELECT memory_id, n, k + 1,
      CASE WHEN length(rest) <= 1600 THEN rest
           WHEN strpos(reverse(substr(rest, 1, 1601)), ' ') BETWEEN 1 AND 1600
             THEN trim(substr(rest, 1, 1601 - strpos(reverse(substr(rest, 1, 1601)), ' ')), {SPACES})
           ELSE trim(substr(rest, 1, 1600), {SPACES}) END,
      CASE WHEN length(rest) <= 1600 THEN ''
           WHEN strpos(reverse(substr(rest, 1, 1601)), ' ') BETWEEN 1 AND 1600
             THEN trim(substr(rest, 1602 - strpos(reverse(substr(rest, 1, 1601)), ' ')), {SPACES})
           ELSE trim(substr(rest, 1601), {SPACES}) END
    FROM long_piece WHERE rest <> ''),
  unit AS (
    SELECT memory_id, n, 0 AS k, s AS u, false AS alone FROM ordered WHERE length(s) <= 1600
    UNION ALL SELECT memory_id, n, k, piece, true FROM long_piece WHERE k > 0 AND piece <> ''),
  seq AS (SELECT memory_id, u, alone, row_number() OVER (PARTITION BY memory_id ORDER BY n, k) AS i FROM unit),
  pack AS (
    SELECT memory_id, i, 1 AS chunk_no, length(u) AS used, alone FROM seq WHERE i = 1
    UNION ALL
    SELECT s.memory_id, s.i,
      CASE WHEN s.alone OR p.alone OR p.used + 1 + length(s.u) > 1600 THEN p.chunk_no + 1 ELSE p.chunk_no END,
      CASE WHEN s.alone OR p.alone OR p.used + 1 + length(s.u) > 1600 THEN length(s.u) ELSE p.used + 1 + length(s.u) END,
      s.alone
    FROM pack p JOIN seq s ON s.memory_id = p.memory_id AND s.i = p.i + 1),
  packed AS (SELECT memory_id, chunk_no, trim(string_agg(u, ' ' ORDER BY i), {SPACES}) AS c
    FROM pack JOIN seq USING (memory_id, i) GROUP BY 1, 2),
  chunked AS (SELECT memory_id, row_number() OVER (PARTITION BY memory_id ORDER BY chunk_no) - 1 AS chunk_index, c AS text FROM packed
    UNION ALL SELECT memory_id, 0, text FROM d WHERE length(text) <= 1600 AND trim(text, {SPACES}) <> '')"""


@query("chunk_text", f"""{CHUNK_SQL}
       SELECT memory_id, chunk_index, length(text) AS n_chars, md5(text) AS text_md5 FROM chunked""")
def chunk_text_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.document_memories(spark, sf).select("memory_id", numbered_rows_of(chunk_text("text"), "i", "c")).where(is_row("c"))
    return rows.select("memory_id", F.col("i").cast("bigint").alias("chunk_index"),
                       F.char_length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("text_md5"))


@query("to_uuid", f"SELECT doc_id, {Q.uuid_of('text')} AS id FROM documents")
def to_uuid_all(spark: SparkSession, sf: str) -> DataFrame:
    return W.load(spark, sf, "documents").select("doc_id", I.to_uuid("text").alias("id"))


@query("times",
       f"""SELECT event_id, {Q.iso("make_timestamp((epoch_us(ts) // 1000) * 1000)")} AS from_ms,
       {Q.iso("make_timestamp((epoch_us(ts) // 1000000) * 1000000)")} AS from_seconds,
       {Q.iso("make_timestamp((epoch_us(ts) // 1000000) * 1000000)")} AS from_text,
       CAST(NULL AS VARCHAR) AS not_positive, CAST(NULL AS VARCHAR) AS not_a_time FROM events""")
def times_all(spark: SparkSession, sf: str) -> DataFrame:
    events = W.load(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    seconds = F.floor(F.col("us") / 1_000_000)
    return events.select(
        "event_id", iso_millis(from_epoch_ms(F.floor(F.col("us") / 1000))).alias("from_ms"),
        iso_millis(from_epoch_seconds(seconds)).alias("from_seconds"),
        iso_millis(from_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("from_text"),
        iso_millis(from_epoch_ms(-F.col("us"))).alias("not_positive"),
        iso_millis(from_iso("event_type")).alias("not_a_time"))


@query("strip_marks", r"""SELECT page_id, md5(html) AS html_md5 FROM pages""")
def strip_marks_all(spark: SparkSession, sf: str) -> DataFrame:
    """Marks are put in front of every line and must all be gone again."""
    marked = F.regexp_replace("html", "(?m)^", chr(0x200E) + chr(0x202A))
    return W.load(spark, sf, "pages").select("page_id", F.md5(T.strip_marks(marked)).alias("html_md5"))


@query("clean_markup",
       rf"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<([^>|]+)\|([^>]+)>', '\2', 'g'),
         '<(https?:[^>|]+)>', '\1', 'g'), {SPACES})) AS clean_md5,
         url||' label '||url AS links FROM pages""")
def clean_markup_all(spark: SparkSession, sf: str) -> DataFrame:
    links = F.concat(F.lit(" <"), "url", F.lit("> <"), "url", F.lit("|label> "), "url")
    return W.load(spark, sf, "pages").select("page_id", F.md5(T.clean_markup("html")).alias("clean_md5"),
                                             T.clean_markup(links).alias("links"))


@query("literal_ranges",
       rf"""WITH d AS (SELECT doc_id, translate(text, {ALPHABETS}) AS f FROM documents),
       s AS (SELECT doc_id, string_split(f, 'the') AS parts FROM d WHERE contains(f, 'the')),
       p AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM s)
       SELECT doc_id, len(parts) - 1 AS matches,
         CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 3 * (i - 1) AS BIGINT) AS start FROM p""")
def literal_ranges_all(spark: SparkSession, sf: str) -> DataFrame:
    docs = W.load(spark, sf, "documents").select("doc_id", T.ascii_lower("text").alias("f"))
    rows = docs.select("doc_id", literal_count(F.col("f"), F.lit("the")).cast("bigint").alias("matches"),
                       rows_of(match_ranges(F.col("f"), F.lit("the")), "r")).where(is_row("r"))
    return rows.select("doc_id", "matches", F.col("r.start").cast("bigint").alias("start"))


@query("regex_ranges",
       r"""SELECT doc_id, len(m) AS matches, md5(array_to_string(m, ',')) AS matches_md5
       FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ing|[0-9]{3,}') AS m FROM documents)""")
def regex_ranges_all(spark: SparkSession, sf: str) -> DataFrame:
    docs = W.load(spark, sf, "documents").select("doc_id", "text", F.lit("[A-Z][a-z]+ing|[0-9]{3,}").alias("expression"))
    ranged = regex_ranges(docs, "text", "expression")
    matched = F.transform("ranges", lambda r: F.substring("text", r["start"] + 1, r["length"]))
    return ranged.select("doc_id", F.size("ranges").cast("bigint").alias("matches"),
                         F.md5(F.array_join(matched, ",")).alias("matches_md5"))


@query("snippet",
       r"""SELECT doc_id, substr(text, greatest(p - 48, 0) + 1, p - greatest(p - 48, 0)) AS before,
         substr(text, p + 1, 3) AS match, substr(text, p + 4, 48) AS after
       FROM (SELECT doc_id, text, strpos(text, 'the') - 1 AS p FROM documents WHERE contains(text, 'the'))""")
def snippet_all(spark: SparkSession, sf: str) -> DataFrame:
    docs = W.load(spark, sf, "documents").where(F.contains("text", F.lit("the")))
    return docs.select("doc_id", snippet(F.col("text"), F.locate("the", "text") - 1, F.lit(3), F.lit(48)).alias("s")).select(
        "doc_id", "s.*")


@query("chunk_key",
       f"""WITH {Q.TURNS} SELECT memory_id||'#'||turn_index AS key, memory_id, CAST(turn_index AS BIGINT) AS chunk_index,
       memory_id AS bare_memory, CAST(0 AS BIGINT) AS bare_index FROM turns""")
def chunk_key_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.turns(spark, sf).withColumn("key", I.chunk_key("memory_id", "turn_index"))
    return rows.select("key", I.chunk_key_memory("key").alias("memory_id"),
                       I.chunk_key_index("key").cast("bigint").alias("chunk_index"),
                       I.chunk_key_memory("memory_id").alias("bare_memory"),
                       I.chunk_key_index("memory_id").cast("bigint").alias("bare_index"))


@query("preview", """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200)||chr(8230) ELSE text END AS shown,
       length(text) > 200 AS truncated FROM documents""")
def preview_all(spark: SparkSession, sf: str) -> DataFrame:
    return W.load(spark, sf, "documents").select("doc_id", T.preview("text").alias("p")).select("doc_id", "p.*")


@query("collapse_whitespace", r"""SELECT page_id, md5(regexp_replace(html, '\s+', ' ', 'g')) AS html_md5 FROM pages""")
def collapse_whitespace_all(spark: SparkSession, sf: str) -> DataFrame:
    return W.load(spark, sf, "pages").select("page_id", F.md5(T.collapse_whitespace("html")).alias("html_md5"))


@query("text_hashes",
       f"""WITH {Q.DOCS} SELECT memory_id, sha256(text) AS sha,
       md5(text||'|'||array_to_string(tags, ',')||'|'||{Q.iso('updated_at')}) AS etag FROM docs""")
def text_hashes_all(spark: SparkSession, sf: str) -> DataFrame:
    return W.document_memories(spark, sf).select(
        "memory_id", I.text_sha256("text").alias("sha"), I.content_etag("text", "tags", "updated_at").alias("etag"))


@query("session_document",
       """SELECT conv_id, md5(string_agg(role||': '||text, chr(10) ORDER BY turn)) AS full_md5,
       md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '')) AS user_md5
       FROM conversations GROUP BY 1""")
def session_document_all(spark: SparkSession, sf: str) -> DataFrame:
    raw = W.load(spark, sf, "conversations")
    turns = raw.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
    return turns.select("conv_id", F.md5(session_document(F.col("turns"), "full")).alias("full_md5"),
                        F.md5(session_document(F.col("turns"), "user-only")).alias("user_md5"))


@query("full_text",
       f"""{CHUNK_SQL} SELECT memory_id, md5(string_agg(text, ' ' ORDER BY chunk_index)) AS shown_md5,
       md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS searched_md5 FROM chunked GROUP BY 1""")
def full_text_all(spark: SparkSession, sf: str) -> DataFrame:
    pieces = W.document_memories(spark, sf).select("memory_id", chunk_text("text").alias("c")).where(F.size("c") > 0)
    return pieces.select("memory_id", F.md5(F.array_join("c", " ")).alias("shown_md5"),
                         F.md5(F.array_join("c", "\n")).alias("searched_md5"))
