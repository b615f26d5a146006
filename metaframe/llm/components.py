"""Connected components by distributed union-find: local forests, then star contraction with joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaframe.llm.shared import written

#: Edges that one local union-find holds at once.
BLOCK = 500_000


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to the least node for each component of these edges."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _forests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        u, v = local_forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in stream:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= BLOCK:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Minima are partial aggregates and joins carry them back, so no node's links meet in memory."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    parent = large.groupBy("u").agg(F.min("v").alias("m"))
    kept = large.join(parent, "u")
    small = kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(parent.select("u", F.col("m").alias("v")))
    return small.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with a link, root the least node that it reaches; edges has long columns u and v, never null.

    Loops, both directions and repeated edges may occur. An empty table gives an empty table. Every round is
    written to the shared folder, so a lost executor costs at most one round. Edges that Python makes should be a
    written table: else a task has two Python workers at once, and both stay for the tasks that follow.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(edges.mapInArrow(_forests, "u long, v long").distinct(), "forest")
    while not now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() or now.groupBy("u").count().where("count > 1").limit(1).count():
        now = written(_stars(now).mapInArrow(_forests, "u long, v long").distinct(), "stars")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
