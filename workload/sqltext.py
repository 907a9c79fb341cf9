"""SQL fragments shared by the oracle statements."""

from __future__ import annotations

from anamnesis.operators.embedding import STOPWORDS


def uuid_of(seed: str) -> str:
    h = f"sha256({seed})"
    variant = f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')"
    return (f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||{variant}"
            f"||substr({h},18,3)||'-'||substr({h},21,12))")


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def tokens(expr: str) -> str:
    return rf"list_filter(string_split_regex(lower({expr}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2)"


CONV = uuid_of("'conv:'||conv_id")
TURN = uuid_of("'conv:'||conv_id||':'||turn")
PARENT = uuid_of("'conv:'||conv_id||':'||(turn-1)")
BRANCH = uuid_of("'conv:'||conv_id||':'||((turn-1)//2)")
DOC = uuid_of("'doc:'||doc_id")
EPOCH = "timestamp '2024-01-01 00:00:00'"

TURNS = f"""turns AS (
  SELECT {TURN} AS memory_id, {CONV} AS conversation_id,
         CASE WHEN turn > 0 THEN {PARENT} END AS parent_id,
         CASE WHEN turn > 0 THEN {BRANCH} END AS branch_id,
         turn AS turn_index, 'role:'||role AS tag, role, upper(role)||': '||text AS text, text AS body,
         {EPOCH} + to_minutes(conv_id * 60 + turn) AS created_at, conv_id, turn
  FROM conversations)"""

DOCS = f"""docs AS (
  SELECT {DOC} AS memory_id, d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic,
         list_concat(['lang:'||d.lang, 'source:'||d.source],
           list_concat(CASE WHEN l.quality = 1 THEN ['quality'] ELSE [] END,
                       CASE WHEN l.toxic = 1 THEN ['toxic'] ELSE [] END)) AS tags,
         {EPOCH} + to_minutes(d.doc_id) AS updated_at
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

VECTORS = """vecs AS (
  SELECT 'm'||lpad(CAST(vec_id // 4 AS VARCHAR), 8, '0') AS memory_id, vec_id % 4 AS chunk_index,
         embedding::DOUBLE[] AS v, label, vec_id FROM embeddings)"""

QUERIES = "asked AS (SELECT 'q'||item_id AS query_id, text AS query_text FROM benchmark)"


def bm25(chunks: str, queries: str = "asked", k: int = 10, allowed: str | None = None, name: str = "sparse") -> str:
    """CTEs that end in `name` (query_id, memory_id, score, rank) over one-chunk texts."""
    keep = f"AND p.memory_id IN ({allowed})" if allowed else ""
    return f"""
  {name}_tok AS (SELECT memory_id, {tokens('text')} AS toks FROM {chunks}),
  {name}_corpus AS (SELECT count(*) AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM {name}_tok),
  {name}_post AS (SELECT memory_id, len(toks) AS dl, unnest(toks) AS term FROM {name}_tok),
  {name}_tf AS (SELECT term, memory_id, any_value(dl) AS dl, count(*) AS tf FROM {name}_post GROUP BY 1, 2),
  {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1),
  {name}_q AS (SELECT DISTINCT query_id, unnest({tokens('query_text')}) AS term FROM {queries}),
  {name}_score AS (
    SELECT q.query_id, p.memory_id,
      round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM {name}_q q JOIN {name}_df USING (term) JOIN {name}_tf p USING (term) CROSS JOIN {name}_corpus
    WHERE true {keep} GROUP BY 1, 2),
  {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank
    FROM {name}_score QUALIFY rank <= {k})"""


def embedded(source: str, key: str, text: str, name: str) -> str:
    """CTEs that end in `name` (key, v): the stand-in embedding of each text as DOUBLE[]."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return rf"""
  {name}_words AS (SELECT {key} AS k, unnest(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+')) AS w FROM {source}),
  {name}_count AS (SELECT k, w, count(*) AS c FROM {name}_words WHERE w <> '' AND w NOT IN ({stop}) GROUP BY 1, 2),
  {name}_vocab AS (SELECT w, sha256(w) AS h FROM (SELECT DISTINCT w FROM {name}_count)),
  {name}_dir AS (SELECT w, list_transform(range(1, 65),
      lambda i: 2 * (strpos('0123456789abcdef', substr(h, i, 1)) - 1) - 15) AS d FROM {name}_vocab),
  {name}_part AS (SELECT k, unnest(range(0, 64)) AS i, unnest(d) * c AS x FROM {name}_count JOIN {name}_dir USING (w)),
  {name}_sum AS (SELECT k, i, sum(x)::DOUBLE AS x FROM {name}_part GROUP BY 1, 2),
  {name}_raw AS (SELECT k, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS norm FROM {name}_sum GROUP BY 1),
  {name} AS (SELECT s.{key} AS {key}, CASE WHEN r.norm > 0
      THEN list_transform(r.v, lambda x: (x / r.norm)::FLOAT)::DOUBLE[]
      ELSE list_transform(range(0, 64), lambda i: 0.0::DOUBLE) END AS v
    FROM {source} s LEFT JOIN {name}_raw r ON s.{key} = r.k)"""


def distance(a: str, b: str) -> str:
    dot = f"list_inner_product({a}, {b})"
    norm = f"(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
    return f"CASE WHEN {norm} = 0 THEN 1.0::DOUBLE ELSE round(1 - {dot} / {norm}, 6) END"


def knn(queries: str, chunks: str, k: int, name: str = "dense", allowed: str | None = None, chunk: str = "0") -> str:
    """CTE `name` (query_id, memory_id, chunk_index, distance, rank)."""
    keep = f"WHERE c.memory_id IN ({allowed})" if allowed else ""
    return f"""
  {name} AS (SELECT query_id, memory_id, chunk_index, distance,
      row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id, chunk_index) AS rank
    FROM (SELECT q.query_id, c.memory_id, {chunk} AS chunk_index, {distance('q.v', 'c.v')} AS distance
          FROM {queries} q CROSS JOIN {chunks} c {keep}) QUALIFY rank <= {k})"""


def fused(depth: int, dense: str = "dense", sparse: str = "sparse", name: str = "fused") -> str:
    """CTE `name` (query_id, memory_id, score, rank, distance): both legs by reciprocal rank."""
    return f"""
  {name}_legs AS (SELECT query_id, memory_id, rank FROM {dense} UNION ALL SELECT query_id, memory_id, rank FROM {sparse}),
  {name}_sum AS (SELECT query_id, memory_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM {name}_legs GROUP BY 1, 2),
  {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank,
      round((row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1) * (0.4::DOUBLE / {max(1, depth - 1)}), 9) AS distance
    FROM {name}_sum QUALIFY rank <= {depth})"""
