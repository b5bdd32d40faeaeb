"""Connected components by rounds of contraction in DataFrames, ended in one task once few edges are left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.shared import cut

#: Edges that one task unites in memory; while there are more, rounds of contraction go on.
LOCAL = 200_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, to: the root of each node of a task's edges, by union and find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [*root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "to"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (columns a, b: longs, not null); nodes are linked if and only if their roots are equal.

    Each round draws a new order of the nodes, joins every node to its first neighbour in it, and keeps the edges
    between what remains, without repeats.  Chains are short under a drawn order, and a constant share of nodes goes in
    each round, so the rounds grow with the logarithm of the nodes.  A node's edges meet only as partial minima.  When
    at most LOCAL edges are left, one task unites them.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    step = 0
    while True:
        left = edges.count()
        if left <= LOCAL:
            first = cut(edges.coalesce(1).mapInArrow(_united, "a long, to long"))
        else:
            step += 1
            order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
            both = edges.union(edges.select("b", "a"))
            least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
            first = cut(least.select("a", F.when(F.col("m") < order("a"), F.col("m.n")).otherwise(F.col("a")).alias("to")))
        if roots is None:
            roots = first.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            roots = cut(roots.join(first.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        if left <= LOCAL:
            return roots
        moved = edges.join(first, "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        moved = moved.join(first.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
        edges = cut(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
