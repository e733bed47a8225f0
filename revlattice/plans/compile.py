"""From the logical tree to one DataFrame; Catalyst does the rest."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from .. import operators as ops
from .expr import All, Constant, Difference, Down, Expr, Filter, Heads, Intersection, Nothing, Range, Union, Up

if TYPE_CHECKING:
    from ..sources.graph import RevGraph


def compile_expr(graph: RevGraph, expr: Expr) -> DataFrame:
    """The set (column rev, no duplicates) that the expression denotes over the graph."""
    run = lambda e: compile_expr(graph, e)
    match expr:
        case Nothing():
            return ops.empty(graph.spark)
        case All():
            return graph.revs
        case Constant(revs):
            return ops.constant(graph.spark, revs)
        case Up(x, lo, hi):
            return ops.descendants(run(x), graph.edges, lo, hi, graph.children_at_hand)
        case Down(x, lo, hi):
            return ops.ancestors(run(x), graph.edges, lo, hi, graph.parents_at_hand)
        case Range(roots, heads):
            return ops.dag_range(run(roots), run(heads), graph.edges)
        case Union(inputs):
            return ops.union(*map(run, inputs)) if inputs else ops.empty(graph.spark)
        case Intersection(inputs):
            return ops.intersection(*map(run, inputs)) if inputs else graph.revs
        case Difference(left, right):
            return ops.difference(run(left), run(right))
        case Heads(x, transitive):
            return ops.heads(run(x), graph.edges, transitive)
        case Filter(x, predicates):
            return filtered(graph, run(x), predicates)
    raise TypeError(expr)


def filtered(graph: RevGraph, revs: DataFrame, predicates) -> DataFrame:
    """The members whose metadata satisfy all predicates: they are applied in the scan of the metadata, before the join."""
    from ..functions.patterns import condition

    if not predicates:
        return revs
    good = graph.commits.where(reduce(lambda a, b: a & b, map(condition, predicates))).select("rev")
    return revs.join(good, "rev", "left_semi")
