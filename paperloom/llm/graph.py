"""Connected components of an edge table, by alternating stars.

Every round sends each node's larger neighbours to its smallest one, then the same for the smaller ones.  Smallest neighbours
come from partial aggregates and are joined back; those of hubs, nodes with more than a fixed share of all edges, are broadcast
to where the edges lie, so a hub's edges never meet in one task.  Before and after each round edges are read in as many tasks as their
number asks for, however many files or partitions they lie in, and a task joins up those it has, a bounded number at a time; so few
rounds are left, and none where all edges are within that bound.  Rounds end when every node has one edge, to a node that has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by, lean, stored, swept

#: Edges that a task joins up at once.
AT_ONCE = 500_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges as stars: every node but the smallest of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges -> stars with the same components; those of AT_ONCE edges are joined with the next, as long as they are few."""
    held, size = [], 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        return _forest(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += len(batch)
        if size >= AT_ONCE:
            a, b = stars()
            if len(a) > AT_ONCE // 2:
                yield out(a, b)
                held, size = [], 0
            else:
                held, size = [(a, b)], len(a)
    if size:
        yield out(*stars())


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges, AT_ONCE at most, -> (node, root) for every node of them."""
    for stars in _joined_up(batches):
        roots = stars.column("b").unique()
        for node, root in ((stars.column("a"), stars.column("b")), (roots, roots)):
            yield pa.RecordBatch.from_arrays([node, root], ["node", "root"])


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    own = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).select("node", "n", F.lit(0).alias("root"))
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.lit(0).cast("long").alias("n"), F.lit(1).alias("root"))
    return own.union(roots).groupBy("node").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where("n > 1 or n > 0 and root > 0").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = stored(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
    joined = joined_by(near, low, ["a"], "n")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    out = stored(out.where("a <> b").distinct())
    discard(low)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), stored; root is the component's smallest node."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        tasks = max(1, -(-now.count() // AT_ONCE))
        if tasks == 1:
            out = stored(now.coalesce(1).mapInArrow(lean(_labelled), "node long, root long"))
            break
        joined = stored(now.coalesce(tasks).mapInArrow(lean(_joined_up), "a long, b long"))
        discard(now)
        now = joined
        if _settled(now):
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            out = stored(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots))
            break
        large = _star(now, True)
        small = _star(large, False)
        discard(now, large)
        now = small
        swept(edges.sparkSession)
    discard(now)
    swept(edges.sparkSession)
    return out
