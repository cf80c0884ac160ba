"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

EDGE = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges (at most its own input) by stars around the least node of each tree."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while above.get(root, root) != root:
            root = above[root]
        while above.get(x, x) != root:
            above[x], x = root, above[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            low, high = (a, b) if a < b else (b, a)
            above.setdefault(low, low)
            above[high] = low
    found = [(x, find(x)) for x in above]
    found = [(x, r) for x, r in found if x != r]
    for i in range(0, len(found), 50_000):
        part = found[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """For every node with an edge ``(u, v)``: ``node`` and ``component``, the least node it reaches.

    Each round is written to the shared folder and replaces the last one. A hub's edges meet its
    least neighbour in a join whose large side Spark may split, and least neighbours are found by
    partial aggregation, so no task holds a whole component. Rounds end when the edges stay as they
    are; their number grows with the logarithm of the longest path.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = written(e.mapInArrow(_forest, EDGE), "edges")
    last = None
    while True:
        mid, least = _large_star(e)
        after, least_2 = _small_star(mid)
        forget(e, mid, least, least_2)
        e = after
        # Stable once a whole round changes no edge; count and hash of the edge set show it.
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = state


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join every larger neighbour of a node to the least of the node and its neighbours; and the table of the least."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    near = least.withColumnRenamed("u", "n")
    return written(both.where("v > u").join(near, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges"), least


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join a node and its smaller neighbours to the least of them; and the table of the least."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    near = least.withColumnRenamed("u", "n")
    lower = down.join(near, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return written(lower.union(near.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "edges"), least
