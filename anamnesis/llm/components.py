"""Connected components of a table of links, without bringing links to the driver.

Each task first contracts its links by union-find, so that at most one link per node and task
is shuffled. Alternating large-star and small-star rounds then move every node to the smallest
node of its component. A star round groups by node with partial aggregates only: no neighbour
list is built, so a node with very many links is no large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.session import cut_lineage

BATCH_LINKS = 1 << 18


def forest(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for the nodes that are not the smallest of their tree."""
    nodes, flat = np.unique(np.concatenate([low, high]), return_inverse=True)
    a, b = flat[:len(low)], flat[len(low):]
    parent = np.arange(len(nodes))
    while True:
        ra, rb = parent[a], parent[b]
        small, large = np.minimum(ra, rb), np.maximum(ra, rb)
        if np.array_equal(small, large):
            break
        np.minimum.at(parent, large, small)
        while True:  # pointer jumping
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_low, held_high, held = [], [], 0
    for batch in batches:
        held_low.append(batch.column(0).to_numpy(zero_copy_only=False))
        held_high.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= BATCH_LINKS:
            node, root = forest(np.concatenate(held_low), np.concatenate(held_high))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])
            held_low, held_high, held = [], [], 0
    if held:
        node, root = forest(np.concatenate(held_low), np.concatenate(held_high))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def connected_components(links: DataFrame, first: str, second: str) -> DataFrame:
    """(node, component): every linked node with the smallest node it reaches.

    Nodes are longs. Nulls and self-links are ignored; an empty table gives an empty result.
    """
    pairs = links.select(F.col(first).cast("long").alias("node"), F.col(second).cast("long").alias("root")).na.drop()
    edges = cut_lineage(pairs.where("node <> root").mapInArrow(_contract, "node long, root long").distinct())
    while True:
        # Large star: every larger neighbour of a node moves to the smallest of node and neighbours.
        both = edges.union(edges.select("root", "node").toDF("node", "root"))
        least = both.groupBy("node").agg(F.min("root").alias("least")).withColumn("least", F.least("node", "least"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"),
                                                                     F.col("least").alias("root"))
        large = cut_lineage(large.where("node <> root").distinct())
        # Small star: a node and its smaller neighbours move to the smallest of them.
        smallest = large.groupBy("node").agg(F.min("root").alias("least"))
        moved = large.join(smallest, "node").select(F.col("root").alias("node"), F.col("least").alias("root")) \
            .where("node <> root")
        following = cut_lineage(moved.union(smallest.select("node", F.col("least").alias("root"))).distinct())
        if _is_star(following):
            return following.select("node", F.col("root").alias("component"))
        edges = following


def _is_star(edges: DataFrame) -> bool:
    """Every node has one root, and no root is a node."""
    twice = edges.groupBy("node").count().where("count > 1").limit(1)
    chained = edges.join(edges.select(F.col("node").alias("root")), "root", "left_semi").select("node").limit(1)
    return twice.count() + chained.count() == 0
