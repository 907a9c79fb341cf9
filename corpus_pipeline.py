"""From raw documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of `documents`. `run` writes each stage's result
as Parquet in the shared checkpoint folder and reads it again as the next one's input.

A document is a row; of rows that repeat a doc_id with other texts each is judged by the id's
strictest result. A null doc_id cannot be joined to a decision, so such a row stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.decontaminate import benchmark_matches
from anamnesis.llm.minhash import near_duplicates
from anamnesis.llm.packing import pack
from anamnesis.llm.pii import redact
from anamnesis.llm.toxicity import learnable, score_rows, train
from anamnesis.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least `TOXIC` go. Labels are learnt from all labelled documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(learnable(docs.select("doc_id", "text"), labels))
    return score_rows(docs, model, "text").where(F.col("_toxicity") < TOXIC).drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays, once."""
    found = near_duplicates(docs, width=5, percent=80)
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials are replaced by their kind; n_chars follows the text."""
    return redact(docs, "text").withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: No stage can be stated in SQL: classifiers, signatures, alignment and vocabularies. See tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
