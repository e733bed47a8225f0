"""Reachability: reflexive closure, bounded walks, ranges of the DAG.

Two ways give the same sets. Edges of at most LOCAL_EDGES rows, a fixed bound that a limited read proves, are held by the
driver in sorted arrays and searched level by level: a distributed job for each level costs more than that whole search.
More edges stay distributed. A closure then runs semi-naive rounds: the frontier joins the edges, what was visited before
falls out by an anti join, and each round's new rows are written to the shared folder, which keeps the plan of a round small
and survives lost executors. While all that was reached is small, the frontier travels as literals, so that the scan prunes.
Bounded walks are one lazy plan.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .relational import ValueRange, constrain
from .sets import constant, empty, intersection

LOCAL_EDGES = 1_000_000
#: Up to so many reached revisions travel as literals.
LITERALS = 2_000
#: Levels whose tables are gathered into one.
GATHER = 8


class Adjacency:
    """Edges in arrays sorted by source."""

    def __init__(self, source: np.ndarray, target: np.ndarray):
        order = np.argsort(source, kind="stable")
        self.source, self.target = source[order], target[order]

    def step(self, revs: np.ndarray) -> np.ndarray:
        """The distinct targets of a set."""
        lo, hi = np.searchsorted(self.source, revs, "left"), np.searchsorted(self.source, revs, "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.unique(self.target[at])

    def closure(self, seeds: np.ndarray) -> np.ndarray:
        seen = frontier = np.unique(seeds)
        levels = [seen]
        while len(frontier):
            frontier = np.setdiff1d(self.step(frontier), seen, assume_unique=True)
            if len(frontier):
                levels.append(frontier)
                seen = np.union1d(seen, frontier) if len(levels) % 16 else np.unique(np.concatenate(levels))
        return seen

    def walk(self, seeds: np.ndarray, lo: int, hi: int | None) -> np.ndarray:
        revs = np.unique(seeds)
        for _ in range(lo):
            revs = self.step(revs)
        if hi is None:
            return self.closure(revs)
        for _ in range(hi - lo):
            more = np.union1d(revs, self.step(revs))
            if len(more) == len(revs):
                break
            revs = more
        return revs


def adjacency(edges: DataFrame, source: str, target: str) -> Adjacency | None:
    """The edges in arrays, or None if there are more than LOCAL_EDGES."""
    table = edges.select(source, target).limit(LOCAL_EDGES + 1).toArrow()
    return None if table.num_rows > LOCAL_EDGES else Adjacency(_array(table, 0), _array(table, 1))


def _array(table: pa.Table, i: int) -> np.ndarray:
    return np.asarray(table.column(i)).astype(np.int64)


def _few(revs: DataFrame, most: int) -> np.ndarray | None:
    """The set's members, or None if there are more than `most`."""
    table = revs.limit(most + 1).toArrow()
    return None if table.num_rows > most else _array(table, 0)


def _frame(like: DataFrame, revs: np.ndarray) -> DataFrame:
    return like.sparkSession.createDataFrame(pa.table({"rev": pa.array(revs, pa.int64())}))


def step(revs: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """The targets of a set's edges, as a set."""
    return edges.join(revs, F.col(source) == F.col("rev"), "left_semi").select(F.col(target).alias("rev")).distinct()


def closure(seeds: DataFrame, edges: DataFrame, source: str = "child", target: str = "parent", local: Adjacency | None | bool = True) -> DataFrame:
    """Everything that the seeds reach along the edges, the seeds included. local: arrays at hand; True: see; False or None: none."""
    local = adjacency(edges, source, target) if local is True else local or None
    if local and (start := _few(seeds, LOCAL_EDGES)) is not None:
        return _frame(seeds, local.closure(start))
    if (start := _few(seeds.distinct(), LITERALS)) is not None:
        seen, frontier = set(start.tolist()), start.tolist()
        while frontier and len(seen) <= LITERALS:
            near = _few(edges.where(F.col(source).isin(frontier)).select(target).distinct(), LITERALS)
            if near is None:
                break
            frontier = sorted(set(near.tolist()) - seen)
            seen |= set(frontier)
        if not frontier:
            return constant(seeds.sparkSession, seen)
        levels, new = [_frame(seeds, np.array(sorted(seen)))], _frame(seeds, np.array(sorted(frontier)))
    else:
        new = materialize(seeds.distinct(), "reached")
        levels = [new]
    while True:
        seen = reduce(DataFrame.unionByName, levels)
        new = materialize(step(new, edges, source, target).join(seen, "rev", "left_anti"), "reached")
        if new.isEmpty():
            return seen
        levels.append(new)
        if len(levels) > GATHER:
            levels = [materialize(reduce(DataFrame.unionByName, levels), "reached")]


def walk(seeds: DataFrame, edges: DataFrame, source: str, target: str, lo: int = 0, hi: int | None = None, local: Adjacency | None | bool = True) -> DataFrame:
    """What some walk of lo to hi edges (hi None: of any number from lo) leads to from a seed. A set; nothing if hi < lo."""
    if hi is not None and hi < lo:
        return empty(seeds.sparkSession)
    if lo == 0 and hi is None:
        return closure(seeds, edges, source, target, local)
    local = adjacency(edges, source, target) if local is True else local or None
    if local and (start := _few(seeds, LOCAL_EDGES)) is not None:
        return _frame(seeds, local.walk(start, lo, hi))
    revs = seeds.distinct()
    for _ in range(lo):
        revs = step(revs, edges, source, target)
    if hi is None:
        return closure(revs, edges, source, target, False)
    for _ in range(hi - lo):
        revs = revs.unionByName(step(revs, edges, source, target)).distinct()
    return revs


def ancestors(revs: DataFrame, edges: DataFrame, lo: int = 0, hi: int | None = None, local: Adjacency | None | bool = True) -> DataFrame:
    return walk(revs, edges, "child", "parent", lo, hi, local)


def descendants(revs: DataFrame, edges: DataFrame, lo: int = 0, hi: int | None = None, local: Adjacency | None | bool = True) -> DataFrame:
    return walk(revs, edges, "parent", "child", lo, hi, local)


def dag_range(roots: DataFrame, heads: DataFrame, edges: DataFrame) -> DataFrame:
    """Descendants of the roots that are ancestors of the heads.

    All edges on a path between them have their child between the least root and the largest head: only those are read. The
    heads' ancestors among them come first, then the roots' descendants along edges within these.
    """
    spark = roots.sparkSession
    low, high = (df.agg(f("rev")).first()[0] for df, f in ((roots, F.min), (heads, F.max)))
    if low is None or high is None or low > high:
        return empty(spark)
    near = constrain(edges, "child", ValueRange(low, high))
    local = adjacency(near, "child", "parent")
    first, last = (_few(x, LOCAL_EDGES) for x in (roots, heads)) if local else (None, None)
    if first is not None and last is not None:
        below = local.closure(last)
        inside = np.isin(local.source, below)
        return _frame(roots, Adjacency(local.target[inside], local.source[inside]).closure(np.intersect1d(first, below)))
    below = closure(heads, near, local=False)
    inside = near.join(below, F.col("child") == F.col("rev"), "left_semi")  # a child's parents are below the heads too
    return closure(intersection(roots, below), inside, "parent", "child", False)
