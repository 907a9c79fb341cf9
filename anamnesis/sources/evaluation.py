"""Evaluation inputs: questions with haystacks, and checkpointed answer records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.sources.lines import read_lines, running_count

QUESTION_SCHEMA = (
    "question_id string, question_type string, question string, answer string, question_date string, "
    "haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role: string, content: string>>>, answer_session_ids array<string>")
RECORD_SCHEMA = ("question_id string, question_type string, abstention boolean, hypothesis string, "
                 "judge_label boolean, reader_model string, judge_model string")


def read_questions(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, haystack, truth) from a JSON array with three parallel arrays per question."""
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.option("multiLine", True).schema(QUESTION_SCHEMA).json(paths)
    rows = rows.where(F.col("question_id").isNotNull())
    questions = rows.select("question_id", "question_type", "question", "answer", "question_date")
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("session_id"), F.col("haystack_dates").alias("date"),
                          F.col("haystack_sessions").alias("turns"))
    haystack = rows.select("question_id", F.posexplode(zipped).alias("place", "s")).select(
        "question_id", "place", "s.session_id", "s.date", "s.turns")
    truth = rows.select("question_id", F.explode("answer_session_ids").alias("item_id"))
    return questions, haystack, truth


def read_checkpoint(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Answer records, the last one per question; torn or foreign lines are ignored."""
    lines = running_count(read_lines(spark, path), F.lit(True), "line_no")
    record = F.from_json(F.when(F.try_parse_json("line").isNotNull(), F.col("line")), RECORD_SCHEMA)
    parsed = lines.select("path", "line_no", record.alias("r")).where(
        F.coalesce(F.col("r.question_id"), F.lit("")) != "")
    return (parsed.groupBy(F.col("r.question_id").alias("id"))
            .agg(F.max_by("r", F.struct("path", "line_no")).alias("r")).select("r.*"))


