"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrocell.storage import materialise


def least_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that edges (u, v) connect it to. In each round every root that an edge joins to
    a lower one hooks onto the lowest such, then all paths are shortened to their root; edges inside a tree fall away."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := root[root], root):
            root = above
    return root


def contract(edges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Edges (u, v), v below u, that join the same nodes: each run of at most ``block`` edges of a task becomes one
    star for each of its components. No shuffle; memory is bounded by the block."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = least_roots(at[: len(u)], at[len(u) :], len(nodes))
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                if n and n + part.num_rows > block:
                    yield stars(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
                held.append([c.to_numpy() for c in part.columns])
                n += part.num_rows
        if n:
            yield stars(*(np.concatenate(x) for x in zip(*held)))

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(node, root) of an undirected graph (a, b) of long nodes: root is the least node of the component; nodes
    that are their own root are left out. Tasks contract the edges they hold; once no more than ``block`` are left,
    which one task holds at once, a last contraction ends it. Until then large-star and small-star rounds join
    what is left, until each node has one neighbour below it and that one has none."""
    down = lambda df: df.where(F.col("u") > F.col("v")).distinct()
    e = materialise(contract(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    while True:
        if e.count() <= block:
            return contract(e.coalesce(1), block).select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = e.union(e.select(F.col("v").alias("u"), "v")).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        if seen.where("low <> high").isEmpty():
            return e.distinct().select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = down(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        # the two sides of small's edges need no distinct: contraction drops repeated edges
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u > v")
        e = materialise(contract(small))
