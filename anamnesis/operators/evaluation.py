"""Retrieval and answer quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from anamnesis.constants import REPORT_KS
from anamnesis.operators.filters import is_abstention
from anamnesis.operators.sizing import attach
from anamnesis.session import cut_lineage

METRIC_DECIMALS = 9


def truth_ranks(hits: DataFrame, truth: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """Rank of every truth id in the retrieved list, null when absent.

    A list that repeats an id counts its first place.
    """
    best = hits.groupBy(*keys, "item_id").agg(F.min("rank").alias("rank"))
    return truth.select(*keys, "item_id").distinct().join(best, [*keys, "item_id"], "left")


def question_scores(ranks: DataFrame, keys: Sequence[str] = ("question_id",),
                    ks: Sequence[int] = REPORT_KS) -> DataFrame:
    """any@k, all@k and reciprocal best rank per scorable question."""
    def within(k: int) -> Column:
        return F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))

    measures = [m for k in ks for m in (F.max(within(k)).alias(f"any_{k}"), F.min(within(k)).alias(f"all_{k}"))]
    return ranks.groupBy(*keys).agg(*measures, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))


def mean_scores(scores: DataFrame, groups: Sequence[str] = (), ks: Sequence[int] = REPORT_KS) -> DataFrame:
    measures = [F.round(F.avg(f"{kind}_{k}"), METRIC_DECIMALS).alias(f"recall_{kind}_{k}")
                for k in ks for kind in ("any", "all")]
    return scores.groupBy(*groups).agg(
        *measures, F.round(F.avg("rr"), METRIC_DECIMALS).alias("mrr"), F.count(F.lit(1)).alias("questions"))


def eval_scopes(scores: DataFrame, ks: Sequence[int] = REPORT_KS) -> DataFrame:
    """Means by retriever and scope, and by question type within each scope.

    `scores` carries retriever, question_id, question_type and the per-question measures.
    """
    scopes = F.when(is_abstention("question_id"), F.array(F.lit("included"))).otherwise(
        F.array(F.lit("excluded"), F.lit("included")))
    scoped = scores.withColumn("scope", F.explode(scopes))
    measures = [F.round(F.avg(f"{kind}_{k}"), METRIC_DECIMALS).alias(f"recall_{kind}_{k}")
                for k in ks for kind in ("any", "all")]
    sets = [[F.col("retriever"), F.col("scope")], [F.col("retriever"), F.col("scope"), F.col("question_type")]]
    return (scoped.groupingSets(sets, "retriever", "scope", "question_type")
            .agg(*measures, F.round(F.avg("rr"), METRIC_DECIMALS).alias("mrr"),
                 F.count(F.lit(1)).alias("questions"), F.grouping("question_type").alias("g"))
            .withColumn("question_type", F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.col("question_type")))
            .drop("g"))


@F.pandas_udf(T.LongType())
def _ordered(values: pd.Series) -> pd.Series:
    """Doubles as integers in the same order; both zeros are one, NaN is the greatest."""
    given = values.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(given), np.nan, given).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def _from_ordered(keys: pd.Series) -> pd.Series:
    bits = keys.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


#: Bits by which a selection narrows the values in one pass.
SELECTION_BITS = 16


def nearest_rank_percentiles(rows: DataFrame, groups: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """(groups, p, percentile): sorted[ceil(p*n/100) - 1] of every group and p, exactly.

    Values become 64-bit keys of the same order. Four passes narrow each wanted rank by 16 bits of
    its key: a pass counts the rows per next 16 bits among those that share the bits found so far. No
    group is sorted and no value is shuffled, only counts, at most 65,536 for a group and rank. Null values do
    not count; groups without a value give no row.
    """
    kind = rows.schema[value].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    key = F.col(value).cast("bigint") if whole else _ordered(F.col(value).cast("double"))
    names = [f"_g{i}" for i in range(max(len(groups), 1))]
    own = [F.col(g) for g in groups] or [F.lit(1)]
    keyed = cut_lineage(rows.where(F.col(value).isNotNull()).select(*[g.alias(n) for g, n in zip(own, names)], key.alias("_key")))
    totals = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    target = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_p") / 100 * F.col("_n")))
    wanted = totals.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("_left", target).drop("_n")
    here = [*names, "_p"]
    for shift in range(64 - SELECTION_BITS, -1, -SELECTION_BITS):
        bucket = F.shiftright("_key", shift).alias("_bucket")
        if shift == 64 - SELECTION_BITS:
            counts = keyed.groupBy(*names, bucket).agg(F.count(F.lit(1)).alias("_c"))
            counts = counts.join(wanted, names)
        else:
            # Rows that share the bits found so far, of all ranks at once; equal prefixes are counted once.
            open_ = cut_lineage(wanted)
            prefixes = open_.select(*names, "_prefix").distinct()
            inside = attach(keyed.withColumn("_prefix", F.shiftright("_key", shift + SELECTION_BITS)), prefixes,
                            [*names, "_prefix"], "left_semi", computed=True)
            counts = inside.groupBy(*names, "_prefix", bucket).agg(F.count(F.lit(1)).alias("_c")).join(
                open_, [*names, "_prefix"]).drop("_prefix")
        running = F.sum("_c").over(Window.partitionBy(*here).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
        reached = counts.withColumn("_sum", running).where(F.col("_sum") >= F.col("_left"))
        first = reached.groupBy(*here).agg(F.min(F.struct("_bucket", (F.col("_left") - F.col("_sum") + F.col("_c")).alias("_rest"))).alias("_f"))
        wanted = first.select(*here, F.col("_f._bucket").alias("_prefix"), F.col("_f._rest").alias("_left"))
    found = F.col("_prefix") if whole else _from_ordered("_prefix")
    return wanted.select(*[F.col(n).alias(g) for g, n in zip(groups, names)], F.col("_p").alias("p"), found.cast(kind).alias("percentile"))


def nearest_rank_percentile(rows: DataFrame, groups: Sequence[str], value: str, p: float) -> DataFrame:
    """(groups, percentile) for one p."""
    return nearest_rank_percentiles(rows, groups, value, [p]).drop("p")


def qa_accuracy(records: DataFrame) -> DataFrame:
    """Accuracy overall, by abstention and by question type: (scope, accuracy, records)."""
    scopes = F.array(F.lit("overall"),
                     F.when(F.col("abstention"), F.lit("abstention")).otherwise(F.lit("non-abstention")),
                     F.concat(F.lit("type:"), "question_type"))
    return (records.select(F.explode(scopes).alias("scope"), F.col("judge_label").cast("int").alias("label"))
            .groupBy("scope")
            .agg(F.round(F.avg("label"), METRIC_DECIMALS).alias("accuracy"), F.count(F.lit(1)).alias("records")))


def judge_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """How often two label tables agree on the questions both hold."""
    a = left.select("question_id", F.col("judge_label").alias("_a"))
    b = right.select("question_id", F.col("judge_label").alias("_b"))
    agree = (F.col("_a") == F.col("_b")).cast("int")
    return a.join(b, "question_id").agg(
        F.round(F.avg(agree), METRIC_DECIMALS).alias("agreement"),
        F.coalesce(F.sum(agree), F.lit(0)).alias("agreed"), F.count(F.lit(1)).alias("questions"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Deterministic sample without replacement; n at or above the size returns every row."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)
