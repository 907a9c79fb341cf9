"""Retrieval and answer quality on labels, vectors and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.operators import evaluation as E
from anamnesis.operators.knn import knn_join
from anamnesis.plans import evaluation as P
from workload import frames as W
from workload import sqltext as Q
from workload.registry import query
from workload.retrieval import EMBEDDER, VQ, vector_queries

# Every vector asks; the truth of a question are the memories that hold its label.
NEIGHBOURS = f"""{Q.VECTORS}, {VQ}, {Q.knn('vq', 'vecs', 10, chunk='c.chunk_index')},
  best AS (SELECT query_id AS question_id, memory_id AS item_id, min(rank) AS rank FROM dense GROUP BY 1, 2),
  truth AS (SELECT DISTINCT 'v'||a.vec_id AS question_id, b.memory_id AS item_id FROM vecs a JOIN vecs b USING (label)
            WHERE a.memory_id = b.memory_id),
  ranks AS (SELECT question_id, item_id, rank FROM truth LEFT JOIN best USING (question_id, item_id)),
  scores AS (SELECT question_id, max(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS any_5, min(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS all_5,
     max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS any_10, min(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS all_10,
     coalesce(1.0::DOUBLE / min(rank), 0.0) AS rr FROM ranks GROUP BY 1)"""
MEANS = """round(avg(any_5), 9) AS recall_any_5, round(avg(all_5), 9) AS recall_all_5, round(avg(any_10), 9) AS recall_any_10,
  round(avg(all_10), 9) AS recall_all_10, round(avg(rr), 9) AS mrr, count(*) AS questions"""


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    hits = knn_join(vector_queries(spark, sf), W.vector_chunks(spark, sf), 10)
    return hits.select(F.col("query_id").alias("question_id"), F.col("memory_id").alias("item_id"), "rank")


def vector_truth(spark: SparkSession, sf: str) -> DataFrame:
    """The memory of the asking vector itself."""
    return W.vector_chunks(spark, sf).select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("question_id"), F.col("memory_id").alias("item_id"))


@query("truth_ranks", f"WITH {NEIGHBOURS} SELECT question_id, item_id, rank FROM ranks")
def truth_ranks_all(spark: SparkSession, sf: str) -> DataFrame:
    return E.truth_ranks(neighbours(spark, sf), vector_truth(spark, sf)).select(
        "question_id", "item_id", F.col("rank").cast("bigint").alias("rank"))


@query("first_rank", f"WITH {NEIGHBOURS} SELECT question_id, item_id, rank FROM best")
def first_rank_all(spark: SparkSession, sf: str) -> DataFrame:
    """First place of every retrieved memory, taken as its own truth."""
    hits = neighbours(spark, sf)
    return E.truth_ranks(hits, hits).select("question_id", "item_id", F.col("rank").cast("bigint").alias("rank"))


@query("recall_at_k", f"WITH {NEIGHBOURS} SELECT {MEANS} FROM scores")
def recall_at_k_all(spark: SparkSession, sf: str) -> DataFrame:
    return E.mean_scores(E.question_scores(E.truth_ranks(neighbours(spark, sf), vector_truth(spark, sf))))


@query("eval_scopes",
       f"""WITH {NEIGHBOURS}, typed AS (SELECT s.*, 'semantic' AS retriever, 'label-'||v.label AS question_type,
         CASE WHEN v.label = 0 THEN s.question_id||'_abs' ELSE s.question_id END AS qid
         FROM scores s JOIN vecs v ON s.question_id = 'v'||v.vec_id),
       scoped AS (SELECT *, 'included' AS scope FROM typed UNION ALL SELECT *, 'excluded' FROM typed WHERE NOT contains(qid, '_abs'))
       SELECT retriever, scope, '(all)' AS question_type, {MEANS} FROM scoped GROUP BY 1, 2
       UNION ALL SELECT retriever, scope, question_type, {MEANS} FROM scoped GROUP BY 1, 2, 3""")
def eval_scopes_all(spark: SparkSession, sf: str) -> DataFrame:
    """Label 0 plays the abstention questions."""
    scores = E.question_scores(E.truth_ranks(neighbours(spark, sf), vector_truth(spark, sf)))
    labels = W.vector_chunks(spark, sf).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("question_id"),
                                               "label")
    typed = scores.join(labels, "question_id").select(
        F.lit("semantic").alias("retriever"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("question_type"),
        F.when(F.col("label") == 0, F.concat("question_id", F.lit("_abs"))).otherwise(F.col("question_id")).alias("question_id"),
        "any_5", "all_5", "any_10", "all_10", "rr")
    return E.eval_scopes(typed)


@query("nearest_rank_percentile",
       """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def percentile_all(spark: SparkSession, sf: str) -> DataFrame:
    events = W.load(spark, sf, "events")
    found = E.nearest_rank_percentiles(events, ["event_type"], "value", [50, 95])
    return found.groupBy("event_type").agg(F.max(F.when(F.col("p") == 50, F.col("percentile"))).alias("p50"),
                                           F.max(F.when(F.col("p") == 95, F.col("percentile"))).alias("p95"))


def label_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as questions by language; the quality label plays the verdict, toxic ones abstain."""
    docs = W.load(spark, sf, "documents").select("doc_id", "lang", "text")
    return W.load(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("question_id"), F.col("lang").alias("question_type"),
        (F.col("toxic") == 1).alias("abstention"), (F.col("quality") == 1).alias("judge_label"), "text")


@query("qa_accuracy",
       """WITH r AS (SELECT lang, toxic = 1 AS abs, quality FROM labels JOIN documents USING (doc_id)),
       s AS (SELECT 'overall' AS scope, quality FROM r UNION ALL
         SELECT CASE WHEN abs THEN 'abstention' ELSE 'non-abstention' END, quality FROM r UNION ALL SELECT 'type:'||lang, quality FROM r)
       SELECT scope, round(avg(quality), 9) AS accuracy, count(*) AS records FROM s GROUP BY 1""")
def qa_accuracy_all(spark: SparkSession, sf: str) -> DataFrame:
    return E.qa_accuracy(label_records(spark, sf))


@query("judge_agreement",
       """SELECT round(avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1 ELSE 0 END), 9) AS agreement,
       CAST(sum(CASE WHEN (quality = 1) = (toxic = 0) THEN 1 ELSE 0 END) AS BIGINT) AS agreed, count(*) AS questions FROM labels""")
def judge_agreement_all(spark: SparkSession, sf: str) -> DataFrame:
    labels = W.load(spark, sf, "labels")
    return E.judge_agreement(labels.select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("judge_label")),
                             labels.select(F.col("doc_id").alias("question_id"), (F.col("toxic") == 0).alias("judge_label")))


@query("judge_label", "SELECT doc_id, contains(lower(text), 'yes') AS label FROM documents")
def judge_label_all(spark: SparkSession, sf: str) -> DataFrame:
    return W.load(spark, sf, "documents").select("doc_id", P.judge_label("text").alias("label"))


@query("seeded_sample")
def seeded_sample_all(spark: SparkSession, sf: str) -> DataFrame:
    return E.seeded_sample(W.load(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100, 7)


def conversation_questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One question per conversation: its first user turn. The haystack are the conversation's
    other turns; the truth is the turn that follows the question."""
    turns = W.load(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("asked"))
    qid = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    joined = turns.join(first, "conv_id")
    questions = joined.where("turn = asked").select(
        qid.alias("query_id"), F.col("text").alias("query_text"),
        F.when(F.col("asked") == 0, "direct").otherwise("primed").alias("question_type"))
    haystack = joined.where("turn <> asked").select(qid.alias("query_id"), F.col("turn").cast("string").alias("memory_id"), "text")
    truth = joined.where("turn = asked + 1").select(qid.alias("query_id"), F.col("turn").cast("string").alias("item_id"))
    return questions, haystack, truth


def per_haystack_sql() -> str:
    return f"""WITH firsts AS (SELECT conv_id, min(turn) AS asked FROM conversations WHERE role = 'user' GROUP BY 1),
  j AS (SELECT * FROM conversations JOIN firsts USING (conv_id)),
  qs AS (SELECT 'c'||conv_id AS query_id, text, CASE WHEN asked = 0 THEN 'direct' ELSE 'primed' END AS question_type FROM j WHERE turn = asked),
  hs AS (SELECT 'c'||conv_id AS query_id, CAST(turn AS VARCHAR) AS memory_id, text, 'c'||conv_id||'#'||turn AS hk FROM j WHERE turn <> asked),
  tr AS (SELECT 'c'||conv_id AS query_id, CAST(turn AS VARCHAR) AS item_id FROM j WHERE turn = asked + 1),
  {Q.embedded('qs', 'query_id', 'text', 'qv')}, {Q.embedded('hs', 'hk', 'text', 'hv')},
  dense AS (SELECT query_id, memory_id, d AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, memory_id) AS rank FROM
    (SELECT hs.query_id, hs.memory_id, {Q.distance('hv.v', 'qv.v')} AS d FROM hs JOIN hv USING (hk) JOIN qv ON qv.query_id = hs.query_id) QUALIFY rank <= 100),
  tok AS (SELECT query_id, memory_id, {Q.tokens('text')} AS toks FROM hs),
  corpus AS (SELECT query_id, count(*) AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM tok GROUP BY 1),
  tf AS (SELECT query_id, memory_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT query_id, memory_id, len(toks) AS dl, unnest(toks) AS term FROM tok) GROUP BY 1, 2, 3),
  df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
  qt AS (SELECT DISTINCT query_id, unnest({Q.tokens('text')}) AS term FROM qs),
  sc AS (SELECT query_id, memory_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM qt JOIN tf USING (query_id, term) JOIN df USING (query_id, term) JOIN corpus USING (query_id) GROUP BY 1, 2),
  sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM sc QUALIFY rank <= 100),
  {Q.fused(10)},
  warm AS (SELECT query_id FROM dense WHERE rank = 1 AND distance < 0.8 UNION SELECT query_id FROM sparse),
  hits AS (SELECT 'semantic' AS retriever, query_id, memory_id AS item_id, rank FROM dense WHERE rank <= 10
    UNION ALL SELECT 'hybrid', query_id, memory_id, rank FROM fused WHERE query_id IN (SELECT query_id FROM warm)),
  grid AS (SELECT DISTINCT r.retriever, tr.query_id, tr.item_id FROM tr, (SELECT 'semantic' AS retriever UNION ALL SELECT 'hybrid') r),
  ranks AS (SELECT g.*, h.rank FROM grid g LEFT JOIN hits h USING (retriever, query_id, item_id)),
  scores AS (SELECT retriever, query_id, max(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS any_5, min(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS all_5,
     max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS any_10, min(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS all_10,
     coalesce(1.0::DOUBLE / min(rank), 0.0) AS rr FROM ranks GROUP BY 1, 2),
  typed AS (SELECT scores.*, question_type FROM scores JOIN qs USING (query_id)),
  scoped AS (SELECT *, unnest(['included', 'excluded']) AS scope FROM typed)
  SELECT retriever, scope, '(all)' AS question_type, {MEANS} FROM scoped GROUP BY 1, 2
  UNION ALL SELECT retriever, scope, question_type, {MEANS} FROM scoped GROUP BY 1, 2, 3"""


@query("retrieval_eval", per_haystack_sql())
def retrieval_eval_all(spark: SparkSession, sf: str) -> DataFrame:
    return P.retrieval_eval(*conversation_questions(spark, sf), EMBEDDER)


@query("reader_prompts",
       """SELECT 'c'||conv_id AS question_id, md5(
         'I will give you several history chats between you and a user. Please answer the question based on the relevant chat history.'
         ||repeat(chr(10), 3)||'History Chats:'||repeat(chr(10), 2)
         ||chr(10)||'### Session 1:'||chr(10)||'Session Date: 2024-01-01'||chr(10)||'Session Content:'||chr(10)
         ||string_agg(repeat(chr(10), 2)||role||': '||trim(text), '' ORDER BY turn)||chr(10)
         ||repeat(chr(10), 2)||'Current Date: 2024-02-01'||chr(10)||'Question: '||arg_min(text, turn)||chr(10)||'Answer:') AS prompt_md5
       FROM conversations GROUP BY conv_id""")
def reader_prompts_all(spark: SparkSession, sf: str) -> DataFrame:
    raw = W.load(spark, sf, "conversations")
    qid = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    sessions = raw.groupBy(qid.alias("question_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"),
        F.min_by("text", "turn").alias("question"))
    haystack = sessions.select("question_id", F.col("question_id").alias("session_id"), F.lit("2024-01-01").alias("date"),
                               F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))
    questions = sessions.select("question_id", "question", F.lit("2024-02-01").alias("question_date"))
    hits = haystack.select("question_id", "session_id", F.lit(1).alias("rank"))
    return P.reader_prompts(questions, haystack, hits).select("question_id", F.md5("prompt").alias("prompt_md5"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("judge_prompt",
       f"""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS question_id, toxic = 1 AS a, lang, text
         FROM labels JOIN documents USING (doc_id))
       SELECT question_id, md5(CASE WHEN a THEN {quoted(P.ABSTENTION_RULE)}
           ELSE {quoted(P.ANSWER_RULE + P.EQUIVALENT_RULE + P.OFF_BY_ONE_RULE)} END
         ||chr(10)||chr(10)||'Question: '||lang||chr(10)||chr(10)||CASE WHEN a THEN 'Explanation' ELSE 'Correct Answer' END
         ||': gold'||chr(10)||chr(10)||'Model Response: '||text||chr(10)||chr(10)
         ||CASE WHEN a THEN {quoted(P.ABSTENTION_QUESTION)} ELSE {quoted(P.CORRECT_QUESTION)} END) AS prompt_md5 FROM r""")
def judge_prompt_all(spark: SparkSession, sf: str) -> DataFrame:
    records = label_records(spark, sf).select(
        "question_id", F.lit("temporal-reasoning").alias("question_type"), "abstention",
        F.col("question_type").alias("question"), F.lit("gold").alias("answer"), F.col("text").alias("hypothesis"))
    return P.judge_prompt(records).select("question_id", F.md5("prompt").alias("prompt_md5"))
