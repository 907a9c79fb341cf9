"""Top-k per group and recency order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """Best `k` rows per group with a 1-based rank; k <= 0 gives no rows.

    Spark pushes the limit below the shuffle (WindowGroupLimit), so each task sends at most k
    rows per group.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= max(k, 0))


def leg_ranks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """1-based rank per query for a leg that carries none."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
