"""Connected components, by alternating large-star and small-star rounds; of few edges, by one task.

Each round costs several shuffles, however small the graph is. Edges that a count proves to be at most ONE_TASK rows are
therefore solved by a single task, of bounded memory; the components are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize


ONE_TASK = 1_000_000


def _solved(batches):
    """Every node of an edge between two nodes, and the least node that it reaches."""
    pairs = [np.stack([np.asarray(x.column(0)), np.asarray(x.column(1))]) for x in batches if x.num_rows]
    a, b = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
    nodes, at = np.unique(np.concatenate([a[a != b], b[a != b]]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (differ := root[a] != root[b]).any():
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(up := root[root], root):
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another: root is the smallest node that it reaches, itself included.

    edges should be a written table: it is counted first. Each round relinks every neighbour above a node to the least neighbour, then every neighbour below it; both keep the
    components and the rounds end, after about the logarithm of the longest path, in stars. A round's edges are written to
    the shared folder. A hot centre is one row on the side of minima, so that its join can be split.
    """
    if edges.count() <= ONE_TASK:
        return materialize(edges.select(F.col(a).cast("long"), F.col(b).cast("long")).dropna().coalesce(1).mapInArrow(_solved, "node long, root long"), "components")
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
