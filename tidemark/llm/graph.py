"""Connected components of an edge list, as DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard


#: Up to so many edges (16 bytes each) are one task's work; rounds of many small stages take far longer.
FEW_EDGES = 1_000_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' components under edges (i, j), by halving paths of the smallest neighbour."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, root) of all edges of a task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = node[forest(len(node), at[: len(a)], at[len(a) :])]
    for lo in range(0, len(node), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + 100_000]), pa.array(root[lo : lo + 100_000])], ["node", "root"])


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Rows (node, root) of every node of ``edges`` (a long, b long): root is the smallest node it reaches.

    Alternating large-star and small-star rounds: each round rewires edges to the
    smallest neighbour, edges never multiply, and the number of rounds grows with
    the logarithm of the longest path. Every round is cut with a checkpoint; only
    two numbers a round reach the driver. Up to ``few`` edges are joined by one
    task, with the same result. Self-loops and nulls are ignored; no edges give no
    rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpoint(e)
    seen = _fingerprint(e)
    if seen[0] <= few:
        return e.coalesce(1).mapInArrow(_joined, "node long, root long")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written before it is joined, so that a hub's many edges can be split in the join.
        wide = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(wide, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        old, e = e, checkpoint(small)
        discard(old, wide)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
