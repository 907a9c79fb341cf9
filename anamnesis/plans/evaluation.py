"""Retrieval evaluation over questions with their own haystacks, and answer evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.constants import REPORT_KS
from anamnesis.operators.bm25 import bm25_per_haystack
from anamnesis.operators.embedding import Embedder, embed_distinct
from anamnesis.operators.evaluation import eval_scopes, question_scores, truth_ranks
from anamnesis.operators.filters import cold_query_gate, is_abstention
from anamnesis.operators.fusion import leg_depth, rrf_fuse
from anamnesis.operators.knn import knn_per_haystack
from anamnesis.session import cut_lineage

DOC_MODES = ("full", "user-only")


def session_document(turns: Column, mode: str) -> Column:
    """Text of one session from its ordered array of (role, content)."""
    if mode == "full":
        lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    elif mode == "user-only":
        lines = F.transform(F.filter(turns, lambda t: t["role"] == "user"), lambda t: t["content"])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.array_join(lines, "\n")


def retrieve_per_question(questions: DataFrame, haystack: DataFrame, retriever: str, k: int) -> DataFrame:
    """Ranked sessions of each question inside its own haystack: (query_id, memory_id, rank)."""
    if retriever == "semantic":
        return knn_per_haystack(questions, haystack, k)
    if retriever != "hybrid":
        raise ValueError(f"unknown retriever {retriever!r}")
    depth = leg_depth(k)
    dense = cut_lineage(knn_per_haystack(questions, haystack, depth))
    sparse = cut_lineage(bm25_per_haystack(questions, haystack, depth))
    return cold_query_gate(rrf_fuse(k, dense, sparse), dense, sparse)


def retrieval_eval(questions: DataFrame, haystack: DataFrame, truth: DataFrame, embedder: Embedder,
                   retrievers: tuple[str, ...] = ("semantic", "hybrid"), cache: DataFrame | None = None) -> DataFrame:
    """recall@k and MRR by retriever, scope and question type.

    questions: query_id, query_text, question_type. haystack: query_id, memory_id, text.
    truth: query_id, item_id. Questions without truth are not scorable and drop out.
    """
    depth = max(REPORT_KS)
    asked = embed_distinct(questions, embedder, cache, "query_text", "query_vector")
    docs = embed_distinct(haystack, embedder, cache, "text", "vector")
    scores = None
    for name in retrievers:
        hits = retrieve_per_question(asked, docs, name, depth).select(
            "query_id", F.col("memory_id").alias("item_id"), "rank")
        ranks = truth_ranks(hits, truth, ("query_id",))
        one = question_scores(ranks, ("query_id",)).withColumn("retriever", F.lit(name))
        scores = one if scores is None else scores.unionByName(one)
    typed = scores.join(questions.select("query_id", "question_type"), "query_id")
    return eval_scopes(typed.withColumnRenamed("query_id", "question_id"))


# Prompt texts of the public benchmark's reader and judge.
READER_INTRO = ("I will give you several history chats between you and a user. "
                "Please answer the question based on the relevant chat history.")
ANSWER_RULE = ("I will give you a question, a correct answer, and a response from a model. Please answer yes if "
               "the response contains the correct answer. Otherwise, answer no. ")
EQUIVALENT_RULE = ("If the response is equivalent to the correct answer or contains all the intermediate steps to "
                   "get the correct answer, you should also answer yes. If the response only contains a subset of "
                   "the information required by the answer, answer no. ")
OFF_BY_ONE_RULE = ("In addition, do not penalize off-by-one errors for the number of days. If the question asks for "
                   "the number of days/weeks/months, etc., and the model makes off-by-one errors (e.g., predicting "
                   "19 days when the answer is 18), the model's response is still correct. ")
UPDATE_RULE = ("If the response contains some previous information along with an updated answer, the response should "
               "be considered as correct as long as the updated answer is the required answer.")
PREFERENCE_RULE = ("I will give you a question, a rubric for desired personalized response, and a response from a "
                   "model. Please answer yes if the response satisfies the desired response. Otherwise, answer no. "
                   "The model does not need to reflect all the points in the rubric. The response is correct as long "
                   "as it recalls and utilizes the user's personal information correctly.")
ABSTENTION_RULE = ("I will give you an unanswerable question, an explanation, and a response from a model. Please "
                   "answer yes if the model correctly identifies the question as unanswerable. The model could say "
                   "that the information is incomplete, or some other information is given but the asked information "
                   "is not.")
CORRECT_QUESTION = "Is the model response correct? Answer yes or no only."
ABSTENTION_QUESTION = "Does the model correctly identify the question as unanswerable? Answer yes or no only."

# (question type, rule, name of the gold field, closing question)
JUDGE_TEMPLATES = (
    ("abstention", ABSTENTION_RULE, "Explanation", ABSTENTION_QUESTION),
    ("single-session-user", ANSWER_RULE + EQUIVALENT_RULE, "Correct Answer", CORRECT_QUESTION),
    ("single-session-assistant", ANSWER_RULE + EQUIVALENT_RULE, "Correct Answer", CORRECT_QUESTION),
    ("multi-session", ANSWER_RULE + EQUIVALENT_RULE, "Correct Answer", CORRECT_QUESTION),
    ("temporal-reasoning", ANSWER_RULE + EQUIVALENT_RULE + OFF_BY_ONE_RULE, "Correct Answer", CORRECT_QUESTION),
    ("knowledge-update", ANSWER_RULE + UPDATE_RULE, "Correct Answer", CORRECT_QUESTION),
    ("single-session-preference", PREFERENCE_RULE, "Rubric", CORRECT_QUESTION),
)


def reader_prompt(sessions: Column, question_date: Column, question: Column) -> Column:
    """Numbered, dated sessions in date order, then the question.

    `sessions` is an array of struct(date, rank, turns), turns being (role, content).
    """
    ordered = F.array_sort(F.transform(sessions, lambda s: F.struct(
        s["date"].alias("date"), s["rank"].alias("rank"), s["turns"].alias("turns"))))
    blocks = F.transform(ordered, lambda s, i: F.concat(
        F.lit("\n### Session "), (i + 1).cast("string"), F.lit(":\nSession Date: "), s["date"],
        F.lit("\nSession Content:\n"),
        F.array_join(F.transform(s["turns"], lambda t: F.concat(
            F.lit("\n\n"), t["role"], F.lit(": "), F.trim(t["content"]))), ""),
        F.lit("\n")))
    return F.concat(F.lit(READER_INTRO + "\n\n\nHistory Chats:\n\n"), F.array_join(blocks, ""),
                    F.lit("\n\nCurrent Date: "), question_date, F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))


def reader_prompts(questions: DataFrame, haystack: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, prompt) from retrieved sessions (question_id, session_id, rank)."""
    found = hits.join(haystack, ["question_id", "session_id"])
    gathered = found.groupBy("question_id").agg(
        F.collect_list(F.struct("date", "rank", "turns")).alias("sessions"))
    return questions.join(gathered, "question_id", "left").select(
        "question_id", reader_prompt(F.coalesce("sessions", F.array().cast(gathered.schema["sessions"].dataType)),
                                     F.col("question_date"), F.col("question")).alias("prompt"))


def judge_prompt(records: DataFrame) -> DataFrame:
    """(question_id, prompt) for records with question, answer and hypothesis.

    A question type without a template stops the job.
    """
    templates = records.sparkSession.createDataFrame(
        JUDGE_TEMPLATES, "template string, rule string, gold string, closing string")
    kind = F.when(F.col("abstention"), F.lit("abstention")).otherwise(F.col("question_type"))
    joined = records.withColumn("template", kind).join(F.broadcast(templates), "template", "left")
    known = F.when(F.col("rule").isNotNull(), F.col("rule")).otherwise(
        F.raise_error(F.concat(F.lit("no judge template for question type "), "template")).cast("string"))
    return joined.select("question_id", F.concat(
        known, F.lit("\n\nQuestion: "), "question", F.lit("\n\n"), "gold", F.lit(": "), "answer",
        F.lit("\n\nModel Response: "), "hypothesis", F.lit("\n\n"), "closing").alias("prompt"))


def judge_label(verdict: Column | str) -> Column:
    return F.contains(F.lower(F.col(verdict) if isinstance(verdict, str) else verdict), F.lit("yes"))


def score_verdicts(questions: DataFrame, verdicts: DataFrame, reader: str, judge: str) -> DataFrame:
    """Answer records from judged verdicts (question_id, hypothesis, verdict)."""
    return verdicts.join(questions.select("question_id", "question_type"), "question_id").select(
        "question_id", "question_type", is_abstention("question_id").alias("abstention"), "hypothesis",
        judge_label("verdict").alias("judge_label"), F.lit(reader).alias("reader_model"),
        F.lit(judge).alias("judge_model"))
