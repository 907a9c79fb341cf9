"""Literal, regex and trigram search of patterns taken from the benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.operators.filters import MetaFilter
from anamnesis.operators.search import trigram_index, trigram_join
from anamnesis.plans.search import search
from workload import frames as W
from workload import sqltext as Q
from workload.registry import query
from workload.text import ALPHABETS

LITERALS = f"""pats AS (SELECT 'b'||item_id AS pattern_id, translate(text, {ALPHABETS}) AS p FROM benchmark
  UNION ALL SELECT 'w'||item_id, translate(regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1), {ALPHABETS}) FROM benchmark)"""
FOLDED = f"f AS (SELECT *, translate(text, {ALPHABETS}) AS low FROM docs)"


def literal_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark text as a whole and its last word, which may be too short to search."""
    items = W.load(spark, sf, "benchmark")
    number = F.col("item_id").cast("string")
    last = F.regexp_extract("text", "([A-Za-z]+)[^A-Za-z]*$", 1)
    both = F.array(F.struct(F.concat(F.lit("b"), number).alias("pattern_id"), F.col("text").alias("pattern")),
                   F.struct(F.concat(F.lit("w"), number).alias("pattern_id"), last.alias("pattern")))
    return items.select(F.explode(both).alias("p")).select("p.*", F.lit(False).alias("regex"), F.lit(True).alias("ignore_case"),
                                                           F.lit(48).alias("context_chars"))


#: Of the length of a text, its remainder by this many decides the kind of its expression.
KINDS = 6


def regex_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Expressions made of the first and last words of each benchmark text: refused look-ahead, start
    and end of the text, word boundaries, alternatives with an anchor, and a word of no fixed length."""
    items = W.load(spark, sf, "benchmark")
    first, last = F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)), F.lower(F.regexp_extract("text", "([A-Za-z]+)[^A-Za-z]*$", 1))
    kind = F.char_length("text") % KINDS
    made = (F.when(kind == 0, F.concat(F.lit("(?="), first, F.lit(")")))
            .when(kind == 1, F.concat(F.lit("^[A-Z][a-z]+|"), first, F.lit("[a-z]+")))
            .when(kind == 2, F.concat(F.lit(r"\b"), first, F.lit(r"\b")))
            .when(kind == 3, F.concat(last, F.lit(r"|[a-z]+\W*$")))
            .when(kind == 4, F.concat(F.lit(r"\b[a-z]"), F.substring(last, 2, 2)))
            .otherwise(F.concat(first, F.lit("[a-z]+"))))
    return items.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("pattern_id"), made.alias("pattern"),
                        F.lit(True).alias("regex"), F.lit(False).alias("ignore_case"), F.lit(48).alias("context_chars"))


def summary_sql(where: str = "true") -> str:
    return f"""WITH {Q.DOCS}, {LITERALS}, {FOLDED},
  hit AS (SELECT pattern_id, memory_id, (length(low) - length(replace(low, p, ''))) // length(p) AS n
    FROM pats CROSS JOIN f WHERE length(p) >= 3 AND contains(low, p) AND {where}),
  tot AS (SELECT pattern_id, CAST(sum(n) AS BIGINT) AS total_matches, count(*) AS total_memories
    FROM hit GROUP BY 1)
  SELECT pattern_id, CASE WHEN p = '' THEN 'empty-query' WHEN length(p) < 3 THEN 'short-query'
      WHEN coalesce(total_matches, 0) = 0 THEN 'no-matches' ELSE 'ok' END AS status,
    coalesce(total_matches, 0) AS total_matches, coalesce(total_memories, 0) AS total_memories
  FROM pats LEFT JOIN tot USING (pattern_id)"""


SNIPPET_SQL = f"""WITH {Q.DOCS}, {LITERALS}, {FOLDED},
  hit AS (SELECT pattern_id, p, memory_id, updated_at, text, string_split(low, p) AS parts FROM pats CROSS JOIN f
    WHERE length(p) >= 3 AND contains(low, p)),
  pos AS (SELECT *, unnest(range(1, least(len(parts), 4))) AS i FROM hit),
  st AS (SELECT *, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + length(p) * (i - 1) AS BIGINT) AS start FROM pos),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC, memory_id, start) AS position
    FROM st QUALIFY position <= 200)
  SELECT pattern_id, memory_id, start, position, substr(text, greatest(start - 48, 0) + 1, start - greatest(start - 48, 0)) AS before,
    substr(text, start + 1, length(p)) AS match, substr(text, start + length(p) + 1, 48) AS after FROM ranked"""


@query("search_summary", summary_sql())
def search_summary(spark: SparkSession, sf: str) -> DataFrame:
    return search(literal_patterns(spark, sf), W.document_memories(spark, sf), with_snippets=False)[0]


@query("search_summary_filtered", summary_sql("list_contains(tags, 'lang:fr') AND NOT list_contains(tags, 'toxic')"))
def search_summary_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return search(literal_patterns(spark, sf), W.document_memories(spark, sf),
                  MetaFilter(tags=("lang:fr",), exclude_tags=("toxic",)), with_snippets=False)[0]


@query("search_summary_no_candidates",
       f"""WITH {LITERALS} SELECT pattern_id, CASE WHEN length(p) < 3 THEN 'short-query' ELSE 'no-candidates' END AS status,
       CAST(0 AS BIGINT) AS total_matches, CAST(0 AS BIGINT) AS total_memories FROM pats""")
def search_no_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return search(literal_patterns(spark, sf), W.document_memories(spark, sf), MetaFilter(tags=("nobody",)),
                  with_snippets=False)[0]


@query("search_snippets", SNIPPET_SQL)
def search_snippets_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = search(literal_patterns(spark, sf), W.document_memories(spark, sf))[1]
    return rows.select("pattern_id", "memory_id", F.col("start").cast("bigint").alias("start"),
                       F.col("position").cast("bigint").alias("position"), "before", "match", "after")


@query("search_regex",
       rf"""WITH {Q.DOCS}, words AS (SELECT 'b'||item_id AS pattern_id, lower(regexp_extract(text, '[A-Za-z]+')) AS f,
         lower(regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1)) AS l, length(text) % {KINDS} AS kind FROM benchmark),
       pats AS (SELECT pattern_id, kind, CASE kind WHEN 1 THEN '^[A-Z][a-z]+|'||f||'[a-z]+' WHEN 2 THEN '\b'||f||'\b'
         WHEN 3 THEN l||'|[a-z]+\W*$' WHEN 4 THEN '\b[a-z]'||substr(l, 2, 2) ELSE f||'[a-z]+' END AS e FROM words),
       hit AS (SELECT pattern_id, memory_id, len(regexp_extract_all(text, e)) AS n FROM pats CROSS JOIN docs WHERE kind <> 0),
       tot AS (SELECT pattern_id, CAST(sum(n) AS BIGINT) AS m, count(*) AS c FROM hit WHERE n > 0 GROUP BY 1)
       SELECT pattern_id, CASE WHEN kind = 0 THEN 'bad-regex' WHEN coalesce(m, 0) = 0 THEN 'no-matches' ELSE 'ok' END AS status,
         coalesce(m, 0) AS total_matches, coalesce(c, 0) AS total_memories FROM pats LEFT JOIN tot USING (pattern_id)""")
def search_regex(spark: SparkSession, sf: str) -> DataFrame:
    return search(regex_patterns(spark, sf), W.document_memories(spark, sf), with_snippets=False)[0]


@query("trigram_join",
       f"""WITH d AS (SELECT {Q.DOC} AS memory_id, translate(text, {ALPHABETS}) AS low FROM documents), {LITERALS},
       g AS (SELECT pattern_id, unnest(list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))) AS t FROM pats),
       need AS (SELECT pattern_id, count(*) AS n FROM g GROUP BY 1),
       held AS (SELECT t, memory_id FROM (SELECT DISTINCT t FROM g) JOIN d ON contains(low, t))
       SELECT pattern_id, memory_id FROM g JOIN held USING (t) JOIN need USING (pattern_id)
       GROUP BY 1, 2 HAVING count(*) = any_value(n)""")
def trigram_join_all(spark: SparkSession, sf: str) -> DataFrame:
    return trigram_join(literal_patterns(spark, sf), trigram_index(W.document_memories(spark, sf)))


@query("trigram_index",
       f"""WITH d AS (SELECT {Q.TURN} AS memory_id, string_split(translate(upper(role)||': '||text, {ALPHABETS}), '') AS c FROM conversations),
       t AS (SELECT memory_id, unnest(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i]||c[i+1]||c[i+2]))) AS g FROM d)
       SELECT g AS trigram, count(*) AS memories FROM t GROUP BY 1""")
def trigram_index_all(spark: SparkSession, sf: str) -> DataFrame:
    return trigram_index(W.turns(spark, sf)).groupBy("trigram").agg(F.count(F.lit(1)).alias("memories"))
