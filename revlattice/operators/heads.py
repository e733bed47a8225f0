"""Heads and roots of a set, and parents of its members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reach import ancestors, descendants
from .sets import difference


def parents_of(revs: DataFrame, edges: DataFrame) -> DataFrame:
    """(rev, parent) for each parent of each member."""
    return revs.join(edges, F.col("rev") == F.col("child")).select("rev", "parent")


def heads(revs: DataFrame, edges: DataFrame, transitive: bool = False) -> DataFrame:
    """Members that are no parent of a member; if transitive, no ancestor of one."""
    if transitive:
        return difference(revs, ancestors(revs, edges, 1))
    inner = edges.join(revs, F.col("child") == F.col("rev"), "left_semi").select(F.col("parent").alias("rev"))
    return difference(revs, inner)


def roots(revs: DataFrame, edges: DataFrame, transitive: bool = False) -> DataFrame:
    """Members that are no child of a member; if transitive, no descendant of one."""
    if transitive:
        return difference(revs, descendants(revs, edges, 1))
    inner = edges.join(revs, F.col("parent") == F.col("rev"), "left_semi").select(F.col("child").alias("rev"))
    return difference(revs, inner)
