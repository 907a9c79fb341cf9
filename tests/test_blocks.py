"""Work by blocks: bounded pieces, fixed partitions, and the answers of a plain scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from anamnesis.operators import kernels as K
from anamnesis.operators.ann import ann_join
from anamnesis.operators.dedup import _near_block_pairs, _near_broadcast
from anamnesis.operators.knn import dealt, knn_join


def units(rows: int, dimensions: int = 6, seed: int = 1) -> np.ndarray:
    return K.unit_rows(np.round(np.random.default_rng(seed).standard_normal((rows, dimensions)), 1))


def plain(rows: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple]]:
    apart = np.maximum(K.distances(rows, queries), 0.0)
    return [sorted((float(apart[i, q]), f"m{i // 4:04d}", i % 4) for i in range(len(rows)))[:k] for q in range(len(queries))]


@pytest.mark.parametrize("k", [1, 7, 500])
def test_nearest_rows_keep_what_a_sort_of_all_pairs_gives(k, monkeypatch):
    monkeypatch.setattr(K, "PAIRS", 512)
    rows, queries = units(300), units(20, seed=2)
    rows[::9] = rows[0]
    state = K.NearestRows(queries, k)
    for low in range(0, 300, 110):
        places = range(low, min(low + 110, 300))
        state.add(pa.array([f"m{i // 4:04d}" for i in places]), pa.array([i % 4 for i in places]), rows[low:low + 110])
    got: dict[str, list] = {}
    for r in state.table(pa.array([str(q) for q in range(20)])).to_pylist():
        got.setdefault(r["query_id"], []).append((r["distance"], r["memory_id"], r["chunk_index"]))
    assert [sorted(got[str(q)]) for q in range(20)] == plain(rows, queries, k)


def test_no_piece_holds_more_pairs_than_the_bound():
    pieces = list(K.NearestRows._pieces([(np.arange(70_000), np.arange(9_000))]))
    assert max(len(a) * len(b) for a, b in pieces) <= K.PAIRS
    assert sum(len(a) * len(b) for a, b in pieces) == 70_000 * 9_000


def test_small_block_pairs_stay_tasks_of_their_own(spark):
    rows = spark.range(64).selectExpr("id % 8 AS _q", "id div 8 AS _c")
    assert dealt(rows, 64, "_q", "_c").rdd.getNumPartitions() == 64


def vectors(spark, rows: np.ndarray):
    return spark.createDataFrame([(f"m{i // 4:04d}", i % 4, [float(x) for x in v]) for i, v in enumerate(rows)],
                                 "memory_id string, chunk_index int, vector array<float>")


def test_lsh_with_large_buckets_meets_every_pair_once(spark):
    chunks = vectors(spark, units(200))
    queries = vectors(spark, units(12, seed=3)).selectExpr("concat(memory_id, '-', chunk_index) AS query_id", "vector AS query_vector")
    exact = {tuple(r) for r in knn_join(queries, chunks, 5).collect()}
    assert {tuple(r) for r in ann_join(queries, chunks, 5, method="lsh", tables=4, bits=0).collect()} == exact
    assert {tuple(r) for r in ann_join(queries, chunks, 5, cells=9, probes=100).collect()} == exact


def test_near_duplicates_by_broadcast_and_by_blocks_agree(spark):
    rows = units(120, 3)
    side = vectors(spark, rows).selectExpr("concat(memory_id, '-', chunk_index) AS memory_id",
                                           "CAST(substr(memory_id, 2) AS BIGINT) * 4 + chunk_index AS input_order", "vector")
    against = side.selectExpr("memory_id AS other_id", "input_order AS other_order", "vector AS other_vector")
    float_rows = K.unit_rows(rows.astype(np.float32).astype(np.float64))
    near = K.distances(float_rows, float_rows) < 0.08
    first = {f"m{i // 4:04d}-{i % 4}": min(j for j in range(i) if near[j, i]) for i in range(120) if near[:i, i].any()}

    def state(ids, orders, vectors):
        return K.EarliestNear(ids, orders, vectors, 0.08)

    for plan in (_near_broadcast, _near_block_pairs):
        found = plan(side, against, state, "memory_id string, near_order bigint").groupBy("memory_id").min("near_order")
        assert dict(map(tuple, found.collect())) == first


def test_rows_and_queries_that_are_there_twice_count_once_in_an_approximate_join(spark):
    chunks = vectors(spark, units(40))
    queries = vectors(spark, units(4, seed=3)).selectExpr("concat(memory_id, '-', chunk_index) AS query_id", "vector AS query_vector")
    hits = ann_join(queries.unionByName(queries), chunks.unionByName(chunks), 6, cells=4, probes=100).collect()
    assert len({(r["query_id"], r["memory_id"], r["chunk_index"]) for r in hits}) == len(hits)
