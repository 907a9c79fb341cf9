"""Exact top-k inner products by the threshold algorithm.

Vectors are quantised to integers and dealt into blocks of bounded rows. In a block every
dimension has a list of its rows sorted by value. A query reads each list from the end its weight
prefers, some entries of all lists at a time, and scores the rows it has not met before. No row
still unmet can score more than the weighted sum of the values reached in the lists. Once that
bound is below the kth score, the block is finished. A bound that equals it goes on, as a tie
may have a smaller id.

The queries are a stated set and are dealt into blocks too; each block of queries meets each
block of vectors in one task. A task gives k rows a query, which are ranked after one shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anamnesis.session import cut_lineage

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
FIRST_DEPTH = 8


class SortedLists:
    """The rows of a block, sorted by every dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[by_id], values[by_id]
        self.order = np.argsort(self.values, axis=0, kind="stable")

    def top(self, weights: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the query's own, best first, ties by smaller id."""
        rows = len(self.ids)
        used = np.flatnonzero(weights)
        rising = weights[used] < 0  # a negative weight prefers small values
        met = self.ids == own_id
        best_rows, best_scores = np.zeros(0, np.int64), np.zeros(0, weights.dtype)
        done, depth = 0, FIRST_DEPTH
        while done < rows:
            if len(used):
                depth = min(depth, rows)
                place = np.where(rising[None, :], np.arange(done, depth)[:, None], rows - 1 - np.arange(done, depth)[:, None])
                fresh = np.zeros(rows, dtype=bool)
                fresh[self.order[place, used[None, :]].ravel()] = True
                fresh &= ~met
            else:  # every row scores zero
                depth, fresh = rows, ~met
            if 2 * (np.count_nonzero(met) + np.count_nonzero(fresh)) >= rows:
                fresh, depth = ~met, rows  # most rows are met: the lists' ends add little
            new = np.flatnonzero(fresh)
            met[new] = True
            best_rows = np.concatenate([best_rows, new])
            best_scores = np.concatenate([best_scores, self.values[new] @ weights])
            if len(best_rows) > k:
                least = np.partition(best_scores, len(best_scores) - k)[len(best_scores) - k]
                near = np.flatnonzero(best_scores >= least)
                keep = near[np.lexsort((best_rows[near], -best_scores[near]))[:k]]
                best_rows, best_scores = best_rows[keep], best_scores[keep]
            done = depth
            if done < rows and len(best_rows) == k:
                at = np.where(rising, done - 1, rows - done)
                bound = (self.values[self.order[at, used], used] * weights[used]).sum()
                if best_scores.min() > bound:
                    break
            depth *= 4
        order = np.lexsort((best_rows, -best_scores))
        return self.ids[best_rows[order]], best_scores[order]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length; missing components are zero. Floats where they hold every product exactly."""
    out = np.zeros((len(lists), width), dtype=np.int64)
    size = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = [], [], []
        if queries.num_rows and vectors.num_rows:
            lists = [t.column("v").combine_chunks() for t in (queries, vectors)]
            width = max(int(x.value_lengths().to_numpy().max()) for x in lists)
            wanted, given = (_matrix(x, width) for x in lists)
            most = float(np.abs(wanted).max()) * float(np.abs(given).max()) * max(width, 1)
            if most < 2 ** 53:
                wanted, given = wanted.astype(np.float64), given.astype(np.float64)
            block = SortedLists(vectors.column("vec_id").to_numpy(), given)
            for query_id, weights in zip(queries.column("vec_id").to_pylist(), wanted):
                ids, scores = block.top(weights, query_id, k)
                found[0].append(np.full(len(ids), query_id))
                found[1].append(ids)
                found[2].append(scores.astype(np.int64))
        columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in found]
        return pa.Table.from_arrays(columns, schema=schema)

    return run, "query_id long, vec_id long, score long"


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component; null where the vector or a component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id",
                vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of every query but its own.

    `is_query` tells the queries by `vec_id`. Ties go to the smaller vec_id. Rows with a null id,
    and vectors that are null or hold null or non-finite components, take no part; an empty
    vector scores 0. Of rows that repeat an id the smallest vector counts. Shorter vectors are
    filled with zeros. Fewer than k other rows give all of them. Other columns are ignored.
    """
    sound = vectors.select(F.col(id_column).cast("long").alias("vec_id"), quantised(F.col(vector_column)).alias("v")) \
        .where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = cut_lineage(sound)
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-total // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
    left = rows.where(is_query).select("vec_id", "v", query_block.alias("query_block"),
                                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = rows.select("vec_id", "v", block.alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    key = ["query_block", "block"]
    run, schema = _search(k)
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
