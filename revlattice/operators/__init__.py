"""Operators on sets of revisions and on relations, as functions over DataFrames.

A set is a DataFrame with one column `rev` (long) without duplicates; edges are a DataFrame (child, parent) with
parent < child.
"""

from .heads import heads, parents_of, roots
from .reach import ancestors, closure, dag_range, descendants, walk
from .relational import ValueRange, constrain, keep, merge_join, newest_first, oldest_first, project, reverse, rows, scan
from .sets import constant, difference, empty, index, intersection, union

__all__ = [
    "ValueRange", "ancestors", "closure", "constant", "constrain", "dag_range", "descendants", "difference", "empty", "heads", "index",
    "intersection", "keep", "merge_join", "newest_first", "oldest_first", "parents_of", "project", "reverse", "roots", "rows", "scan", "union", "walk",
]
