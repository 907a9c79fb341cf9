"""Centroid clustering; every vector finds its nearest centroid by the threshold algorithm.

Vectors are integers, so that assignments, sums and distances are exact. The centroids of a round
are few. For each dimension they stand in a list sorted by value. A vector enters every list at its
own value and walks outward, the nearer side first; a centroid met in any list gets its exact
distance. A centroid met in no list is at least as far in every dimension as that list's frontier,
so once the summed squared frontier strictly exceeds the best distance, the vector is done. An equal sum goes
on, as a tie may have a smaller number. All vectors of a slice walk together.

A round adds up, in each task, the components of every cluster; what is shuffled and what the
driver gets is a row per cluster and dimension, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.session import cut_lineage

SLICE_ROWS = 1024
#: Beyond every distance: for 64-bit integers, and for Python integers.
_NONE, _LARGE_NONE = np.iinfo(np.int64).max, 1 << 2200


class CentroidLists:
    """The centroids of a round (k x dimensions, integers), sorted in every dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of every row; ties go to the smaller number."""
        rows, dims = vectors.shape
        count = len(self.centroids)
        none = _LARGE_NONE if vectors.dtype == object else _NONE
        best = np.full(rows, none, dtype=vectors.dtype)
        cluster = np.full(rows, count, dtype=np.int64)
        met = np.zeros((rows, count), dtype=bool)
        high = np.empty((rows, dims), dtype=np.int64)
        for d in range(dims):
            high[:, d] = np.searchsorted(self.values[:, d], vectors[:, d])
        low = high - 1
        walking = np.arange(rows)
        every = np.arange(dims)[None, :]
        while len(walking):
            x, lo, hi = vectors[walking], low[walking], high[walking]
            below = np.where(lo >= 0, x - self.values[np.maximum(lo, 0), every], none)
            above = np.where(hi < count, self.values[np.minimum(hi, count - 1), every] - x, none)
            frontier = np.minimum(below, above)
            open_row = (frontier * frontier).sum(axis=1) <= best[walking]
            walking, lo, hi = walking[open_row], lo[open_row], hi[open_row]
            down = (below <= above)[open_row]
            number = self.order[np.where(down, lo, hi), every]
            fresh = np.zeros((len(walking), count), dtype=bool)
            fresh[np.arange(len(walking))[:, None], number] = True
            fresh &= ~met[walking]
            low[walking], high[walking] = lo - down, hi + ~down
            at, number = np.nonzero(fresh)  # in each row by ascending number
            row = walking[at]
            met[row, number] = True
            change = vectors[row] - self.centroids[number]
            distance = (change * change).sum(axis=1)
            order = np.lexsort((number, distance, row))
            row, number, distance = row[order], number[order], distance[order]
            head = np.ones(len(row), dtype=bool)
            head[1:] = row[1:] != row[:-1]
            row, number, distance = row[head], number[head], distance[head]
            better = (distance < best[row]) | ((distance == best[row]) & (number < cluster[row]))
            best[row[better]], cluster[row[better]] = distance[better], number[better]
            walking = walking[~met[walking].all(axis=1)]
        return cluster, best


def quantised_matrix(lists: pa.Array, dims: int, factor: int) -> np.ndarray:
    """floor(factor * x) of lists of `dims` finite numbers. Integers too large for an exact
    distance in 64 bits become Python integers: slow, and an error only if a distance is no long."""
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor)
    if len(flat) and np.abs(flat).max() * 2 * dims ** 0.5 >= 2.0 ** 31:
        return np.array([int(x) for x in flat.tolist()], dtype=object).reshape(-1, dims)
    return flat.astype(np.int64).reshape(-1, dims)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, factor: int):
    """(batch rows, matrix, cluster, distance) slice by slice."""
    lists = CentroidLists(centroids)
    objects = CentroidLists(centroids.astype(object))
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(low, SLICE_ROWS)
            matrix = quantised_matrix(part.column(1), centroids.shape[1], factor)
            large = matrix.dtype == object or np.abs(centroids).max() >= 2 ** 26
            cluster, distance = objects.nearest(matrix.astype(object)) if large else lists.nearest(matrix)
            yield part, matrix, cluster, distance


def _sums(centroids: np.ndarray, factor: int):
    """Per task and cluster: the sum of every component, and the rows under dimension -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, dims = centroids.shape
        total = np.zeros((count, dims + 1), dtype=object)
        for _, matrix, cluster, _ in _assigned(batches, centroids, factor):
            order = np.argsort(cluster, kind="stable")
            there, first = np.unique(cluster[order], return_index=True)
            total[there, :dims] += np.add.reduceat(matrix[order], first, axis=0)
            total[there, dims] += np.bincount(cluster, minlength=count)[there]
        number, dim = np.divmod(np.arange(count * (dims + 1)), dims + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int32()), pa.array(np.where(dim == dims, -1, dim), pa.int32()),
             pa.array(total.ravel().tolist(), pa.int64())], ["cluster", "dim", "total"])

    return run, "cluster int, dim int, total long"


def _labels(centroids: np.ndarray, factor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance in _assigned(batches, centroids, factor):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                ["vec_id", "cluster", "distance"])

    return run, "vec_id long, cluster int, distance long"


def sound(vector: Column, dims: int) -> Column:
    """Exactly `dims` components, none of them null or not finite."""
    return F.coalesce((F.size(vector) == dims) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def cluster_vectors(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, factor: int = 64,
                    seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept row.

    Kept are rows with exactly `dims` components, none null or not finite, as floor(factor * x).
    The first centroids are the `clusters` kept rows with the smallest sha256 of `seed:vec_id`; of
    rows that repeat an id the smaller vector comes first; a row with a null id starts no centroid
    but is assigned. Fewer rows with an id give fewer centroids, none give an empty result. Each
    round assigns all rows (ties: smaller number) and replaces every non-empty centroid by the floor of
    its mean; at last all rows are assigned once more. An assignment or sum that is no 64-bit
    integer is an error. Other columns are ignored.
    """
    kept = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v")) \
        .where(sound(F.col("v"), dims))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").select(draw.alias("draw"), "v").orderBy("draw", "v").limit(clusters).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, "
                                                        "inertia long, centroid_sha256 string")
    centroids = quantised_matrix(pa.array([r.v for r in first], pa.list_(pa.float64())), dims, factor)
    for _ in range(rounds):
        run, schema = _sums(centroids, factor)
        totals = kept.mapInArrow(run, schema).groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()
        table = {(r.cluster, r.dim): r.total for r in totals}
        moved = centroids.astype(object)
        for c in range(len(moved)):
            if table.get((c, -1)):
                moved[c] = [table[c, d] // table[c, -1] for d in range(dims)]
        centroids = moved.astype(np.int64)
    run, schema = _labels(centroids, factor)
    found = cut_lineage(kept.mapInArrow(run, schema))
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    inertia = sum(sums.values())
    digest = [hashlib.sha256(",".join(str(x) for x in c).encode()).hexdigest() for c in centroids.tolist()]
    # A row per cluster: its number is the bound of this broadcast.
    about = vectors.sparkSession.createDataFrame(
        [(c, total, inertia, digest[c]) for c, total in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster") \
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
